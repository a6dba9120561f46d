"""Table changes as pure functions (existing, incoming) -> new table, and a versioned Parquet store.

Parquet has no MERGE, so a change is an anti-join or an outer join on the natural key. Order among equal keys is
always given by a column; nothing depends on arrival in partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.session import written


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_last(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last value of each key by ``seq``; max_by combines on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(new table, stats): first of each key in order, unless stored. Stats: total_rows, saved, skipped, errors."""
    first = keep_first(incoming, keys, order)
    fresh = first.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    stats = incoming.agg(F.count("*").alias("total_rows")).join(fresh.agg(F.count("*").alias("saved")))
    stats = stats.select("total_rows", "saved", (F.col("total_rows") - F.col("saved")).alias("skipped"), F.lit(0).cast("long").alias("errors"))
    return existing.unionByName(fresh.select(*existing.columns)), stats


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], replace: Sequence[str]) -> DataFrame:
    """One row per key: stored rows keep their columns but for ``replace``, which the incoming row gives; new keys are added.
    Keys compare null-safely. ``incoming`` has one row per key."""
    e, i = existing.alias("e"), incoming.alias("i")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"e.{k}").eqNullSafe(F.col(f"i.{k}"))
    marked = e.withColumn("_old", F.lit(True)).alias("e").join(i.withColumn("_new", F.lit(True)).alias("i"), cond, "full_outer")
    out = []
    for c in existing.columns:
        new, old = F.col(f"i.{c}"), F.col(f"e.{c}")
        pick = F.when(F.col("e._old").isNull(), new)
        if c in replace:
            pick = pick.when(F.col("i._new").isNotNull(), new)
        out.append(pick.otherwise(old).alias(c))
    return marked.select(*out)


def delete_keys(existing: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = gone.select(*keys).distinct()
    return existing.join(g, null_safe(existing, g, keys), "left_anti")


def assign_ids(existing: DataFrame, fresh: DataFrame, id_col: str, order: Sequence[Column]) -> DataFrame:
    """New keys get max(id) + their rank. The rank is by range partitions and their offsets, not one task's window."""
    ranged = written(fresh.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ids")
    per = ranged.groupBy("_p").count()
    start = per.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_start"))  # a row per partition
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    joined = local.join(F.broadcast(start), "_p").join(F.broadcast(top))
    return joined.withColumn(id_col, (F.col("_top") + F.col("_start") + F.col("_r")).cast("long")).drop("_p", "_r", "_start", "_top")


def set_status(rows: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """``changes``: (id, status); one row per id."""
    c = changes.select(F.col(id_col).alias("_id"), F.col("status").alias("_status"))
    return rows.join(c, rows[id_col] == c["_id"], "left").withColumn("status", F.coalesce("_status", "status")).drop("_id", "_status")


def replace_values(rows: DataFrame, changes: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """``changes``: (id, column), one row an id; the whole value is replaced, a struct or document too."""
    c = changes.select(F.col(id_col).alias("_id"), F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    new = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))
    return rows.join(c, rows[id_col] == c["_id"], "left").withColumn(column, new).drop("_id", "_new", "_hit")


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that are missing or null get their default."""
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in defaults.items()})


def not_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cnt): keys that several rows have; null keys are no fault, as in a database."""
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("cnt")).filter("cnt > 1")


def reset_status(rows: DataFrame, states: Sequence[str] = ("processed", "failed", "processing")) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("status").isin(*states), "raw").otherwise(F.col("status")))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is still there (ON DELETE CASCADE)."""
    p = parents.select(F.col(parent_key).alias("_pk")).distinct()
    return children.join(p, children[child_key] == p["_pk"], "left_semi")


def nullify(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """The key becomes null where the parent is gone (ON DELETE SET NULL)."""
    p = parents.select(F.col(parent_key).alias("_pk")).distinct()
    return children.join(p, children[child_key] == p["_pk"], "left").withColumn(child_key, F.when(F.col("_pk").isNotNull(), F.col(child_key))).drop("_pk")


@dataclass
class Rule:
    name: str
    test: Column


def validate(rows: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with the names of the broken rules); a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(r.test, F.lit(False)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    marked = rows.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


class TableStore:
    """Versioned Parquet tables. A version is a manifest: a numbered file that lists the table's parts. A change writes its part
    first and then the next manifest, which appears whole by a rename, so readers keep theirs and a writer that dies leaves
    nothing behind that counts. Two writers of one version: the second rename fails and that writer raises."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self, name: str) -> int:
        fs, folder = self._files(f"{self.root}/{name}/manifests")
        if not fs.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)

    def parts(self, name: str, version: int | None = None) -> list[str]:
        now = self.version(name) if version is None else version
        if now == 0:
            return []
        fs, where = self._files(f"{self.root}/{name}/manifests/{now:010d}")
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{name}/{p}" for p in self.parts(name, version)])

    def _commit(self, name: str, parts: Sequence[str], number: int) -> int:
        fs, draft = self._files(f"{self.root}/{name}/manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write("\n".join(parts).encode())
        out.close()
        final = self._files(f"{self.root}/{name}/manifests/{number:010d}")[1]
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"{name}: another writer made version {number}")
        return number

    def _part(self, name: str, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{part}")
        return part

    def write(self, name: str, rows: DataFrame) -> int:
        """Replaces the table."""
        number = self.version(name) + 1
        return self._commit(name, [self._part(name, rows)], number)

    def append(self, name: str, rows: DataFrame) -> int:
        """Adds rows; what is stored is neither read nor written."""
        number = self.version(name) + 1
        return self._commit(name, [*self.parts(name, number - 1), self._part(name, rows)], number)

    def truncate(self, name: str) -> int:
        """The table without rows; new ids start again at 1."""
        return self.write(name, self.read(name).limit(0))

    def compact(self, name: str, most: int, how: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Rewrites a table of more than ``most`` parts as one, through ``how``."""
        if len(self.parts(name)) > most:
            self.write(name, how(self.read(name)))
