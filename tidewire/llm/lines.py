"""Lines repeated across one source's documents, kept up incrementally.

Method: a state in a shared folder (``store.TableStore``: numbered manifests over appended parts, so another process goes on
where the last one ended) holds, per source, how many documents contain each line (a 64-bit key of its letters), how many
documents there are, and per document its line keys. ``merge`` adds a new partition of documents as a delta: its counts
are appended, none is rewritten; only the delta's lines and the lines over the threshold so far can cross it, so only these
are summed; and only the documents that contain a crossed line are rebuilt, found from the key table without reading
a text again. A document that comes again in a later delta replaces its earlier state. A first merge into an empty state is the
batch form. Counts of more than ``MOST_PARTS`` deltas are summed into one.

A line counts as repeated if it occurs in at least ``min_docs`` documents and in at least ``min_share`` of
its source's documents. Lines are equal if their letters are, ignoring case; a document counts once.

Scale: text is read once and leaves the scan as 8 bytes a line; counting combines on the map side before its
shuffle, so a boilerplate line of a source with a third of all rows arrives as one row a task. A source has at
most (lines per document) / min_share repeated lines, so the table of repeated lines is small; it is broadcast only
if its counted rows are below ``BROADCAST_ROWS``, else joined by key, one row a key. A rebuild joins texts by their
own key, never by source.

Defined results: null text or source gives no row; empty lines and lines without letters are no lines;
repeated rows of one id count once (those of one delta with the lines of all of them); empty tables give
empty results; texts of any length are processed whole; other columns are ignored. Two lines of one source
share a key with probability about n^2 / 2^65 for n distinct lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.store import TableStore
from tidewire.session import scratch_path, written

BROADCAST_ROWS = 500_000
MOST_PARTS = 8


def line_letters(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"\P{L}+", ""))


def line_keys(text: Column, source: Column) -> Column:
    """array<bigint>: per line its key, null for lines without letters."""

    def key(line: Column) -> Column:
        letters = line_letters(line)
        return F.when(letters != "", F.xxhash64(source, letters))

    return F.transform(F.split(text, "\n", -1), key)


class RepeatedLines:
    """The incremental state below ``path`` (a folder all executors share)."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 5, min_share: float = 0.1):
        self.spark, self.min_docs, self.min_share = spark, min_docs, min_share
        self.store = TableStore(spark, path or scratch_path(spark, "lines"))

    def _or_empty(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name) if self.store.version(name) else self.spark.createDataFrame([], schema)

    def keys(self) -> DataFrame:
        """(id, source, keys, delta) of all documents, as they came last."""
        every = self._or_empty("keys", "id bigint, source int, keys array<bigint>, delta int")
        if not self.store.version("gone"):
            return every
        return every.join(self.store.read("gone"), ["id", "delta"], "left_anti")

    def counts(self) -> DataFrame:
        """(source, key, n) of all lines."""
        return self.store.read("counts").groupBy("source", "key").agg(F.sum("n").alias("n"))

    def crossed(self) -> DataFrame:
        """(source, key): the lines over the threshold."""
        return self._or_empty("crossed", "source int, key bigint")

    def merge(self, rows: DataFrame, key: str = "id", source: str = "source_id", text: str = "raw_text") -> DataFrame:
        """Adds a partition of documents; returns (source, key, now) of the lines whose state changed."""
        store, number = self.store, self.store.version("keys") + 1
        read = rows.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).filter("id is not null and source is not null")
        read = read.select("id", "source", F.coalesce(line_keys(F.col("text"), F.col("source")), F.array().cast("array<bigint>")).alias("keys"))
        before = self.keys() if number > 1 else None
        store.append("keys", read.withColumn("delta", F.lit(number)))
        new = self.spark.read.parquet(f"{store.root}/keys/{store.parts('keys')[-1]}")
        docs = new.groupBy("source").agg(F.count_distinct("id").alias("docs"), F.count("*").alias("rows"))
        twice = docs.filter("rows > docs").limit(1).count() > 0
        # Equal ids lie side by side after one small shuffle of numbers only where there are any.
        lines = self._lines(new, twice)
        docs = docs.select("source", "docs")
        if before is not None:
            # Documents that came before: their lines are taken out again.
            old = written(before.join(new.select("id").distinct(), "id", "left_semi"), "again")
            if old.limit(1).count():
                store.append("gone", old.select("id", "delta"))
                minus = old.groupBy("source").agg((-F.count_distinct("id")).alias("docs"))
                docs = docs.unionByName(minus).groupBy("source").agg(F.sum("docs").alias("docs"))
                lines = lines.unionByName(self._lines(old, True).withColumn("n", -F.col("n"))).groupBy("source", "key").agg(F.sum("n").alias("n"))
        store.append("docs", docs.coalesce(1))
        store.append("counts", lines)
        was = self.crossed()
        if before is None:
            counted = store.read("counts")
        else:
            # Only a line of this delta, or one over the threshold so far, can cross it.
            part = self.spark.read.parquet(f"{store.root}/counts/{store.parts('counts')[-1]}")
            touched = part.select("source", "key").unionByName(was).distinct()
            counted = store.read("counts").join(touched, ["source", "key"], "left_semi").groupBy("source", "key").agg(F.sum("n").alias("n"))
        sizes = store.read("docs").groupBy("source").agg(F.sum("docs").alias("docs"))  # a row a source
        # Most lines occur once: the filter on n runs before the join with the source sizes.
        over = counted.filter(F.col("n") >= self.min_docs).join(sizes, "source").filter(F.col("n") >= self.min_share * F.col("docs") - 1e-9)
        store.write("crossed", over.select("source", "key"))
        store.compact("counts", MOST_PARTS, lambda c: c.groupBy("source", "key").agg(F.sum("n").alias("n")).filter("n <> 0"))
        store.compact("docs", MOST_PARTS, lambda d: d.groupBy("source").agg(F.sum("docs").alias("docs")).coalesce(1))
        now = self.crossed().withColumn("now", F.lit(True))
        if before is None:
            return now
        both = now.join(was.withColumn("was", F.lit(True)), ["source", "key"], "full_outer")
        return both.filter("now is null or was is null").select("source", "key", F.coalesce("now", F.lit(False)).alias("now"))

    @staticmethod
    def _lines(docs: DataFrame, twice: bool) -> DataFrame:
        """(source, key, n): documents per line."""
        per = docs.select("id", "source", F.explode(F.array_distinct("keys")).alias("key")).filter("key is not null")
        return (per.distinct() if twice else per).groupBy("source", "key").agg(F.count("*").alias("n"))

    def _against(self, lines: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return lines.join(F.broadcast(keys) if small else keys, ["source", "key"], how)

    def found(self) -> DataFrame:
        """(raw_article_id, line_no): every line that is repeated in its source, counted from 1."""
        lines = self.keys().select("id", "source", F.posexplode("keys").alias("pos", "key")).filter("key is not null")
        hit = self._against(lines, self.crossed(), "left_semi")
        return hit.select(F.col("id").alias("raw_article_id"), (F.col("pos") + 1).alias("line_no"))

    def affected(self, changed: DataFrame) -> DataFrame:
        """(id): the documents that contain a line whose state changed; these and no others need a rebuild."""
        lines = self.keys().select("id", "source", F.explode(F.array_distinct("keys")).alias("key"))
        return self._against(lines, changed.select("source", "key"), "left_semi").select("id").distinct()

    def rebuild(self, rows: DataFrame, changed: DataFrame | None = None, key: str = "id", source: str = "source_id", text: str = "raw_text") -> DataFrame:
        """(id, text): the documents without their repeated lines, or only those that ``changed`` lines affect; documents without
        a source stay whole."""
        rows = rows.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
        if changed is not None:
            rows = rows.join(self.affected(changed), "id", "left_semi")
        drop = self.crossed()
        keys = line_keys(F.col("text"), F.col("source"))
        parts = F.arrays_zip(F.split("text", "\n", -1).alias("line"), keys.alias("key"))
        if drop.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            per_source = drop.groupBy("source").agg(F.collect_set("key").alias("drop"))  # bounded, see above
            joined = rows.join(F.broadcast(per_source), "source", "left")
        else:
            # Only numbers are joined by line; texts meet their own lines by their print.
            rows = rows.withColumn("print", F.xxhash64("id", "source", "text"))
            lines = rows.select("print", "source", F.explode(F.array_distinct(keys)).alias("key")).filter("key is not null").distinct()
            own = lines.join(drop, ["source", "key"], "left_semi").groupBy("print").agg(F.collect_set("key").alias("drop"))
            joined = rows.join(own, "print", "left")
        kept = F.filter(parts, lambda x: x["key"].isNull() | F.col("drop").isNull() | ~F.array_contains("drop", F.coalesce(x["key"], F.lit(0))))
        return joined.select("id", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))
