"""Pipelines composed of the other operators: entity extraction to links, alias clean-up, questions, comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.replies import parse_cleanup, parse_entities
from tidewire.functions.text import buckets, canonical_name, importance_label, noise_class
from tidewire.operators import entities as ent
from tidewire.operators import extract as ext
from tidewire.operators.store import assign_ids, delete_keys, keep_first, upsert
from tidewire.operators.summaries import complete
from tidewire.session import written
from tidewire.sources.landed import day_spine

TEXT_LIMIT = 8000  # what a language model reads of an article; a parameter of its prompt, not of any result here


def processed_articles(existing: DataFrame, cleaned: DataFrame) -> DataFrame:
    """New processed articles (raw_article_id, title, text) under fresh ids; stored ones keep id, title and text. Texts are
    stored whole."""
    fresh = cleaned.select(F.col("id").alias("raw_article_id"), "title", "text")
    fresh = fresh.join(existing.select("raw_article_id"), "raw_article_id", "left_anti")
    return assign_ids(existing, fresh, "id", [F.col("raw_article_id")]).select("id", "raw_article_id", "title", "text")


def link_entities(raw: DataFrame, sources: DataFrame, processed: DataFrame, entities: DataFrame, links: DataFrame, aliases: DataFrame, engine: str = "gazetteer", **options) -> dict[str, DataFrame]:
    """One plan for a whole backlog: clean, register, extract, canonicalise, link. Returns the new rows of processed_articles,
    entities and article_entities, and the new status of every article (an article whose extraction fails is 'failed')."""
    cleaned = written(ext.clean_articles(raw, sources), "cleaned")
    new = written(processed_articles(processed, cleaned), "processed")
    mentions = written(ext.extract(cleaned, engine, **options), "mentions")
    good = mentions.filter("error is null")
    rolled = ent.mention_rollup(good)
    named = rolled.select("article_id", F.col("normalized_name").alias("name"), F.col("entity_type").alias("type"), "original_name", "count", "importance_score", "context_snippet")
    resolved = written(ent.resolve_aliases(named, aliases), "resolved")
    keys = keep_first(resolved.select(F.col("canonical_name").alias("normalized_name"), F.col("canonical_type").alias("type"), "original_name", "article_id"), ["normalized_name", "type"], [F.col("article_id"), F.col("original_name")])
    unknown = keys.join(entities.select("normalized_name", "type"), ["normalized_name", "type"], "left_anti").drop("article_id")
    fresh = written(assign_ids(entities, unknown, "id", [F.col("normalized_name"), F.col("type")]), "entities")
    ids = entities.select("id", "normalized_name", "type").unionByName(fresh.select("id", "normalized_name", "type"))
    all_articles = processed.select("id", "raw_article_id").unionByName(new.select("id", "raw_article_id"))
    edges = resolved.join(ids.select(F.col("id").alias("entity_id"), F.col("normalized_name").alias("canonical_name"), F.col("type").alias("canonical_type")), ["canonical_name", "canonical_type"])
    edges = edges.join(all_articles.select(F.col("id").alias("processed_article_id"), F.col("raw_article_id").alias("article_id")), "article_id")
    # Two mentions that resolve to one entity: the first name counts.
    edges = keep_first(edges, ["processed_article_id", "entity_id"], [F.col("name"), F.col("type")])
    edges = edges.join(links.select("processed_article_id", "entity_id"), ["processed_article_id", "entity_id"], "left_anti")
    edges = edges.select("processed_article_id", "entity_id", "count", "importance_score", "context_snippet")
    failed = mentions.filter("error is not null").select(F.col("article_id").alias("id"), F.lit(True).alias("_f")).distinct()
    status = raw.select("id").join(failed, "id", "left").select("id", F.when(F.col("_f"), "failed").otherwise("processed").alias("status"))
    return {"processed_articles": new, "entities": fresh, "article_entities": edges, "status": status}


def model_mentions(cleaned: DataFrame, client: Callable[[str], str], prompt: str = "Назови сущности:\n") -> DataFrame:
    """Entities a language model names in each article; a failing call or a bad reply gives none."""
    rows = cleaned.select("id", "title", "text", F.concat(F.lit(prompt), F.coalesce("title", F.lit("")), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, TEXT_LIMIT)).alias("prompt"))
    return parse_entities(complete(rows, client)).select("id", "original_name", "normalized_name", "entity_type", "count", "importance_score", "context_snippet")


def apply_aliases(stored: DataFrame, proposed: DataFrame, fixes: DataFrame) -> DataFrame:
    """The alias rows to add: an alias wins over a type fix of the same key; a row whose (lower name, type) is a stored
    canonical is dropped (it would make a circle), and so is one whose key is stored."""
    a = proposed.select("alias_name", "alias_type", "canonical_name", "canonical_type", F.lit(0).alias("prio"))
    f = fixes.select(F.col("name").alias("alias_name"), F.col("current_type").alias("alias_type"), F.col("name").alias("canonical_name"), F.col("correct_type").alias("canonical_type"), F.lit(1).alias("prio"))
    rows = keep_first(a.unionByName(f), ["alias_name", "alias_type"], [F.col("prio"), F.col("canonical_name")]).drop("prio")
    canon = stored.filter(F.col("canonical_type") != ent.DISCARD).select(F.lower("canonical_name").alias("_n"), F.col("canonical_type").alias("_t")).distinct()
    rows = rows.join(canon, (F.lower("alias_name") == F.col("_n")) & (F.col("alias_type") == F.col("_t")), "left_anti")
    return delete_keys(rows, stored, ["alias_name", "alias_type"])


def drop_discards(entities: DataFrame, links: DataFrame, aliases: DataFrame, discards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, links, aliases) without the discarded (name, type) and with a discard alias for each."""
    d = discards.filter("name is not null and type is not null").select("name", "type").distinct()
    dead = entities.join(d.withColumnRenamed("name", "normalized_name"), ["normalized_name", "type"], "left_semi").select(F.col("id").alias("entity_id"))
    marks = d.select(F.col("name").alias("alias_name"), F.col("type").alias("alias_type"), F.col("name").alias("canonical_name"), F.lit(ent.DISCARD).alias("canonical_type"))
    new = upsert(aliases.select("alias_name", "alias_type", "canonical_name", "canonical_type"), marks, ["alias_name", "alias_type"], ["canonical_name", "canonical_type"])
    return delete_keys(entities, dead.select(F.col("entity_id").alias("id")), ["id"]), delete_keys(links, dead, ["entity_id"]), new


def cleanup(entities: DataFrame, links: DataFrame, aliases: DataFrame, client: Callable[[str], str], least: int = 5, size: int = 80, step: int = 50) -> dict[str, DataFrame]:
    """Frequent names in overlapping batches to a model, its proposals as alias rows, fixes and discards (reported, not applied)."""
    frequent = written(ent.entity_frequency(entities, links, least), "frequent")
    head = ent.top_per_type(frequent).select("id", "normalized_name", "type")
    tail = frequent.join(head.select("id"), "id", "left_anti").select("id", "normalized_name", "type")

    def batches(rows: DataFrame, part: str, order) -> DataFrame:
        none = rows.sparkSession.createDataFrame([], "n bigint")
        rows = rows.withColumn("_last", ent.last_word(F.col("normalized_name"))).withColumn("_low", F.lower("normalized_name"))
        ranked = written(assign_ids(none, rows, "n", [F.col(c) for c in order]).withColumn("i", F.col("n") - 1).drop("n", "_last", "_low"), "ranked")
        return ent.sliding_batches(ranked, "i", ranked.count(), size, step).withColumn("part", F.lit(part))

    rows = batches(head, "head", ["_low", "id"]).unionByName(batches(tail, "tail", ["_last", "_low", "id"]))
    listed = rows.groupBy("part", "batch").agg(F.array_sort(F.collect_list(F.struct("i", "normalized_name", "type"))).alias("names"))  # at most ``size`` a batch
    prompts = listed.select("part", "batch", F.to_json(F.transform("names", lambda x: F.struct(x["normalized_name"].alias("name"), x["type"].alias("type")))).alias("prompt"))
    replies = written(complete(prompts, client).withColumn("r", parse_cleanup(F.col("reply"))), "replies")
    proposed = replies.select(F.inline("r.aliases")).filter("alias_name is not null and canonical_name is not null")
    fixes = replies.select(F.inline("r.type_fixes")).filter("name is not null")
    discards = replies.select(F.inline("r.discard")).distinct()
    return {"aliases": apply_aliases(aliases, proposed.distinct(), fixes.distinct()), "discards": discards, "batches": prompts}


def answer(articles: DataFrame, question: str, client: Callable[[str], str], newest: bool = False, fetch: int = 30, use: int = 20) -> str | None:
    """A model's answer over waiting articles, the oldest first as stored rules have it, or the newest."""
    order = [F.desc_nulls_last("retrieved_at"), F.desc("id")] if newest else [F.asc_nulls_last("retrieved_at"), F.asc("id")]
    rows = articles.filter("status = 'raw'").orderBy(*order).limit(fetch).limit(use).select(F.substring(F.coalesce("raw_title", F.lit("")), 1, 100).alias("t"), F.substring(F.coalesce("raw_text", F.lit("")), 1, 300).alias("x"))
    posts = "\n\n".join(f"{r['t']}\n{r['x']}" for r in rows.collect())
    try:
        return client(f"{posts}\n\nВопрос: {question}")
    except Exception as e:  # noqa: BLE001
        return f"{type(e).__name__}: {e}"


def compare_engines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(engine, total, articles, per_article, noise, common): two engines' mentions (article_id, normalized_name, entity_type)."""
    keys = ("article_id", "normalized_name", "entity_type")
    agreement = ent.key_agreement(left, right, keys).select("common")
    both = left.select(*keys, F.lit("left").alias("engine")).unionByName(right.select(*keys, F.lit("right").alias("engine"))).filter("normalized_name is not null").distinct()
    per = both.groupBy("engine").agg(F.count("*").alias("total"), F.count_distinct("article_id").alias("articles"), F.count_if(noise_class(F.col("normalized_name")).isNotNull()).alias("noise"))
    return per.withColumn("per_article", F.round(F.col("total") / F.col("articles"), 3)).join(F.broadcast(agreement))


def engine_profile(mentions: DataFrame) -> DataFrame:
    """(engine, type, importance, cnt) of (engine, entity_type, importance_score) rows."""
    return mentions.groupBy("engine", F.col("entity_type").alias("type"), importance_label(F.col("importance_score")).alias("importance")).agg(F.count("*").alias("cnt"))


#: Importance labels in the order of display.
LABELS = ("subject", "key", "mention")


def only_left(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("article_id", "normalized_name", "entity_type")) -> DataFrame:
    """The left engine's mentions the right one has not, with the place ``rank`` of their importance for the order of display
    (rank, type, name)."""
    rows = left.join(right.select(*keys).distinct(), list(keys), "left_anti")
    return rows.withColumn("rank", F.array_position(F.array(*[F.lit(x) for x in LABELS]), importance_label(F.col("importance_score"))).cast("int"))


def backfill(spark: SparkSession, first: str, last: str, run: Callable[[str], int]) -> DataFrame:
    """(day, rows, error): a period day by day; a day that fails is listed with its error and the others go on. Each day is a job of
    its own by definition, so that a failed one can be run again."""
    out = []
    for r in day_spine(spark, first, last).collect():  # a row a day
        day = r["day"].isoformat()
        try:
            out.append((day, int(run(day)), None))
        except Exception as e:  # noqa: BLE001
            out.append((day, None, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(out, "day string, rows bigint, error string")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, for people to read and to hand back."""
    rows.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def diagnose(mentions: DataFrame, examples: int = 10) -> DataFrame:
    """(bucket, cnt, share, examples): faulty names among an engine's mentions, with the first examples by name."""
    rows = mentions.filter("normalized_name is not null").select("normalized_name", F.explode(buckets(F.col("normalized_name"))).alias("bucket"))
    total = mentions.agg(F.count("normalized_name").alias("n"))  # one row
    names = rows.select("bucket", "normalized_name").distinct()
    w = Window.partitionBy("bucket").orderBy("normalized_name")
    firsts = names.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= examples).groupBy("bucket").agg(F.array_sort(F.collect_list("normalized_name")).alias("examples"))
    per = rows.groupBy("bucket").agg(F.count("*").alias("cnt")).join(F.broadcast(total))
    return per.select("bucket", "cnt", F.round(F.col("cnt") / F.col("n"), 4).alias("share")).join(firsts, "bucket")


__all__ = ["answer", "apply_aliases", "canonical_name", "cleanup", "compare_engines", "diagnose", "drop_discards", "link_entities", "model_mentions", "processed_articles"]
