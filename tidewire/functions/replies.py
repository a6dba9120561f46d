"""Replies of language models, read by column expressions: bad JSON never raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import occurrences, snippet, strip_code_fence

#: Entity types and importance scores.
ENTITY_TYPES = ("person", "organization", "location", "event", "concept")
SCORES = {"subject": 1.0, "key": 0.7, "mention": 0.3}
REPLY = "array<struct<mention:string,canonical:string,type:string,importance:string>>"
CLEANUP = (
    "struct<aliases:array<struct<alias_name:string,alias_type:string,canonical_name:string,canonical_type:string>>,"
    "type_fixes:array<struct<name:string,current_type:string,correct_type:string>>,discard:array<struct<name:string,type:string>>>"
)
SUMMARY = "struct<topics:array<string>,summary:string,trend:string,important_events:array<string>>"


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_array(text: Column, schema: str) -> Column:
    """The parsed array; empty where the reply is not valid JSON or not an array."""
    body = strip_code_fence(text)
    good = body.startswith("[") & is_json(body)
    return F.when(good, F.from_json(body, schema)).otherwise(F.from_json(F.lit("[]"), schema))


def parse_entities(replies: DataFrame, text: str = "text", reply: str = "reply", types: tuple[str, ...] = ENTITY_TYPES, unique: bool = True) -> DataFrame:
    """One row per valid entity: original_name, normalized_name, entity_type, count, importance_score, context_snippet.

    Items need a canonical name and a known type; importance defaults to mention, the mention to the canonical
    name. Within a reply the first of equal (lower canonical, type) counts.
    """
    rows = replies.withColumn("_key", F.monotonically_increasing_id()).select("*", F.posexplode(json_array(F.col(reply), REPLY)).alias("_pos", "_e"))
    name = F.trim(F.col("_e.canonical"))
    rows = rows.withColumn("normalized_name", name).withColumn("entity_type", F.lower(F.trim(F.col("_e.type"))))
    rows = rows.filter((F.coalesce(F.col("normalized_name"), F.lit("")) != "") & F.col("entity_type").isin(*types))
    mention = F.coalesce(F.nullif(F.trim(F.col("_e.mention")), F.lit("")), F.col("normalized_name"))
    rows = rows.withColumn("original_name", mention)
    if unique:
        w = Window.partitionBy("_key", F.lower("normalized_name"), "entity_type").orderBy("_pos")
        rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), F.lower(F.col("_e.importance"))), F.lit(SCORES["mention"]))
    body = F.coalesce(F.col(text), F.lit(""))
    return rows.select(
        *replies.columns,
        "original_name",
        "normalized_name",
        "entity_type",
        occurrences(body, F.col("original_name")).alias("count"),
        score.alias("importance_score"),
        snippet(body, F.col("original_name")).alias("context_snippet"),
    )


def parse_cleanup(reply: Column) -> Column:
    """The struct of aliases, type fixes and discards; empty lists where the reply is no object."""
    body = strip_code_fence(reply)
    empty = F.lit('{"aliases":[],"type_fixes":[],"discard":[]}')
    return F.from_json(F.when(body.startswith("{") & is_json(body), body).otherwise(empty), CLEANUP)


def parse_summary(reply: Column) -> Column:
    """The summary document; where the reply is none, its text (cut) is the summary."""
    body = strip_code_fence(reply)
    fallback = F.struct(
        F.array().cast("array<string>").alias("topics"),
        F.substring(F.coalesce(reply, F.lit("")), 1, 500).alias("summary"),
        F.lit("").alias("trend"),
        F.array().cast("array<string>").alias("important_events"),
    )
    return F.when(body.startswith("{") & is_json(body), F.from_json(body, SUMMARY)).otherwise(fallback)


def coerce_json(text: Column) -> Column:
    """Valid JSON as variant, blank or bad text as null."""
    return F.try_parse_json(F.nullif(F.trim(text), F.lit("")))
