"""Entities: alias resolution, merging by aliases, clean-up batches, mention roll-up, comparison of extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import canonical_name
from tidewire.operators.store import assign_ids, keep_first
from tidewire.session import written

DISCARD = "discard"


def resolve_aliases(names: DataFrame, aliases: DataFrame, name: str = "name", kind: str = "type") -> DataFrame:
    """``names`` with canonical_name and canonical_type: an alias matches ignoring case; one of the same type beats an
    untyped one, then alias_name and id decide. Without alias the name itself, normalised; discarded names are left out.
    """
    a = aliases.select(F.lower("alias_name").alias("_k"), "alias_name", "alias_type", "canonical_name", "canonical_type", F.col("id").alias("_aid")).filter("_k is not null")
    best = Window.partitionBy("_k", "alias_type").orderBy(F.col("alias_name").asc(), F.col("_aid").asc())
    a = a.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    typed = a.filter("alias_type is not null").select(F.col("_k").alias("_tk"), F.col("alias_type").alias("_t"), F.struct("canonical_name", "canonical_type").alias("_typed"))
    untyped = a.filter("alias_type is null").select(F.col("_k").alias("_uk"), F.struct("canonical_name", "canonical_type").alias("_untyped"))
    # Two equi-joins on at most one row a key: no ranking over the matches of the (larger) name side.
    low = F.lower(F.col(name))
    rows = names.withColumn("_low", low)
    rows = rows.join(typed, (F.col("_low") == F.col("_tk")) & (F.col(kind) == F.col("_t")), "left").join(untyped, F.col("_low") == F.col("_uk"), "left")
    hit = F.coalesce("_typed", "_untyped")
    out = rows.withColumn("canonical_name", canonical_name(F.coalesce(hit["canonical_name"], F.substring(F.col(name), 1, 500))))
    out = out.withColumn("canonical_type", F.coalesce(hit["canonical_type"], F.col(kind))).drop("_low", "_tk", "_t", "_uk", "_typed", "_untyped")
    return out.filter(F.col("canonical_type") != DISCARD)


def upsert_entities(existing: DataFrame, names: DataFrame, aliases: DataFrame, name: str = "name", kind: str = "type", seq: str = "seq") -> DataFrame:
    """New (normalized_name, type) keys of the names: the first original name wins; is_new tells whether it was stored."""
    found = resolve_aliases(names, aliases, name, kind)
    keyed = found.select(F.col("canonical_name").alias("normalized_name"), F.col("canonical_type").alias("type"), F.col(name).alias("original_name"), seq)
    first = keep_first(keyed, ["normalized_name", "type"], [F.col(seq)])
    old = existing.select("normalized_name", "type", F.lit(True).alias("_old")).distinct()
    return first.join(old, ["normalized_name", "type"], "left").withColumn("is_new", F.col("_old").isNull()).drop("_old")


def final_targets(pairs: DataFrame) -> DataFrame:
    """(source, target) with chains followed to their end; what runs in a circle is left out. Pointers double each round, so as
    many rounds as the number of pairs has bits reach the end of any chain; what moves still is a circle."""
    jump = written(pairs.select("source", "target"), "chain")
    for _ in range(jump.count().bit_length() + 1):
        nxt = jump.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        new = written(jump.join(nxt, "target", "left").select("source", F.coalesce("_next", "target").alias("target")), "chain")
        moved = new.join(jump.withColumnRenamed("target", "_was"), "source").filter("target <> _was").limit(1).count()
        jump = new
        if not moved:
            break
    still = pairs.select(F.col("source").alias("target")).distinct()
    return jump.filter("source <> target").join(still, "target", "left_anti").select("source", "target")


def with_canonicals(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, normalized_name, type, created): the entities and, under new ids in the order of their names, the canonicals that
    their aliases lead to and that are not stored; a created one may have an alias itself."""
    a = aliases.filter((F.col("canonical_type") != DISCARD) & F.col("canonical_name").isNotNull()).select("alias_name", "alias_type", "canonical_name", "canonical_type")
    stored = entities.select("id", "normalized_name", "type")
    known = written(stored.select("normalized_name", "type").distinct(), "known")
    created, front = None, known
    while True:  # a round without a new name ends it, and names are those of the aliases
        hit = front.join(a, F.col("normalized_name") == F.col("alias_name")).filter("alias_type is null or alias_type = type")
        new = hit.select(F.col("canonical_name").alias("normalized_name"), F.col("canonical_type").alias("type")).distinct()
        front = written(new.join(known, ["normalized_name", "type"], "left_anti"), "created")
        if not front.limit(1).count():
            break
        created = front if created is None else created.unionByName(front)
        known = written(known.unionByName(front), "known")
    if created is None:
        return stored.withColumn("created", F.lit(False))
    fresh = assign_ids(stored, created, "id", [F.col("normalized_name"), F.col("type")]).select("id", "normalized_name", "type")
    return stored.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)))


def merge_by_aliases(entities: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities left, edges rewritten, (source, target) moves): entities whose normalized_name is (by case) an alias go to
    the canonical entity of the alias, which is created where it is not stored; discards and self-merges are skipped; chains are
    followed to their end. An edge the target already has wins over a moved one, then the least id."""
    a = aliases.filter(F.col("canonical_type") != DISCARD).select("alias_name", "alias_type", "canonical_name", "canonical_type", F.col("id").alias("_aid"))
    every = written(with_canonicals(entities, aliases), "every")
    entities = entities.unionByName(every.filter("created").drop("created"), allowMissingColumns=True)
    src = entities.select(F.col("id").alias("source"), F.col("normalized_name").alias("alias_name"), F.col("type").alias("_type"))
    hit = src.join(a, "alias_name").filter("alias_type is null or alias_type = _type")
    dst = entities.groupBy(F.col("normalized_name").alias("canonical_name"), F.col("type").alias("canonical_type")).agg(F.min("id").alias("target"))
    hit = hit.join(dst, ["canonical_name", "canonical_type"]).filter("source <> target")
    pairs = hit.groupBy("source").agg(F.min_by("target", F.struct(F.col("alias_type").isNull(), "alias_name", "_aid")).alias("target"))
    moves = final_targets(pairs)
    m = moves.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    moved = edges.join(m, edges["entity_id"] == m["_s"], "left").withColumn("_moved", F.col("_t").isNotNull()).withColumn("entity_id", F.coalesce("_t", "entity_id")).drop("_s", "_t")
    kept = keep_first(moved, ["processed_article_id", "entity_id"], [F.col("_moved"), F.col("id")]).drop("_moved")
    left = entities.join(moves.select(F.col("source").alias("id")), "id", "left_anti")
    return left, kept, moves


def entity_frequency(entities: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(id, normalized_name, type, articles): entities of at least ``least`` distinct articles."""
    n = edges.groupBy("entity_id").agg(F.count_distinct("processed_article_id").alias("articles")).filter(F.col("articles") >= least)
    # The large side is aggregated before it is joined.
    return entities.select("id", "normalized_name", "type").join(n, entities["id"] == n["entity_id"]).select("id", "normalized_name", "type", "articles")


def without_alias(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities that no alias names, ignoring case; an untyped alias covers every type."""
    a = aliases.select(F.lower("alias_name").alias("_k"), "alias_type")
    e = entities.withColumn("_k", F.lower("normalized_name"))
    return e.join(a, (e["_k"] == a["_k"]) & (a["alias_type"].isNull() | (e["type"] == a["alias_type"])), "left_anti").drop("_k")


def top_per_type(frequency: DataFrame, n: int = 50, types: tuple[str, ...] = ("person", "organization", "location")) -> DataFrame:
    w = Window.partitionBy("type").orderBy(F.desc("articles"), F.col("id"))
    return frequency.filter(F.col("type").isin(*types)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def last_word(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def sliding_batches(rows: DataFrame, position: str, total: int, size: int = 80, step: int = 50) -> DataFrame:
    """(batch, *rows): overlapping windows of ``size`` rows every ``step``; the last may be short; one if all fit.
    ``position`` counts from 0 in the order of the batches."""
    last = 0 if total <= size else -((size - total) // step)
    i = F.col(position)
    low = F.greatest(F.lit(0), F.ceil((i - size + 1) / step).cast("int"))
    high = F.least(F.lit(last), F.floor(i / step).cast("int"))
    return rows.filter(low <= high).select(F.explode(F.sequence(low, high)).alias("batch"), "*")


def merge_report(entities: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """(source, target, links): what a merge would do, without doing it."""
    _, _, moves = merge_by_aliases(entities, edges, aliases)
    links = edges.groupBy(F.col("entity_id").alias("source")).agg(F.count("*").alias("links"))
    return moves.join(links, "source", "left").select("source", "target", F.coalesce("links", F.lit(0)).alias("links"))


def in_chunks(rows: DataFrame, order: list[Column], size: int = 20) -> DataFrame:
    """``rows`` with the number of their chunk of ``size`` rows in the order, from 0."""
    none = rows.sparkSession.createDataFrame([], "_at bigint")
    return assign_ids(none, rows, "_at", order).withColumn("chunk", F.floor((F.col("_at") - 1) / size)).drop("_at")


def mention_rollup(mentions: DataFrame, keys: tuple[str, ...] = ("article_id", "normalized_name", "entity_type"), start: str = "start") -> DataFrame:
    """Per key: count, greatest importance, and the first mention's text and context."""
    return mentions.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.max("importance_score").alias("importance_score"),
        F.min_by("original_name", start).alias("original_name"),
        F.min_by("context_snippet", start).alias("context_snippet"),
    )


def contained_names(names: DataFrame, name: str = "name", kind: str = "type") -> DataFrame:
    """(short, long, type): a one-word name that is a word of a longer name of the type. By equi-join on the words."""
    low = names.select(F.col(name).alias("n"), F.col(kind).alias("type")).distinct()
    words = F.array_distinct(F.split(F.lower(F.trim("n")), r"\s+"))
    long = low.filter(F.size(words) > 1).select(F.col("n").alias("long"), "type", F.explode(words).alias("w"))
    short = low.filter(F.size(words) == 1).select(F.col("n").alias("short"), "type", F.lower(F.trim("n")).alias("w"))
    return short.join(long, ["w", "type"]).select("short", "long", "type").distinct()


def key_agreement(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: common, left_only, right_only of two key sets; one shuffle of the union by key."""
    l = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
    r = right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    per = l.unionByName(r).groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.agg(
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("common"),
        F.coalesce(F.sum(F.col("l") * (1 - F.col("r"))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum((1 - F.col("l")) * F.col("r")), F.lit(0)).alias("right_only"),
    )
