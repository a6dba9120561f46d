"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import boilerplate, leakage, mixing, names, reading, sql, topics, truncation
from tidewire.llm.lines import RepeatedLines
from tidewire.llm.pairs import pair_counts
from tidewire.session import scratch_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_aliases"))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tables with the number of their entity."""
    return names.resolve(names.spellings(table(spark, sf_dir, "entities"), table(spark, sf_dir, "entity_aliases")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "processed_articles")
    fitted = topics.assign(articles, table(spark, sf_dir, "topic_labels"), table(spark, sf_dir, "topic_names"))
    return fitted.posteriors().select("processed_article_id", "topic").distinct()


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject area: articles and mean share of the text."""
    articles = table(spark, sf_dir, "processed_articles")
    fitted = topics.assign(articles, table(spark, sf_dir, "topic_labels"), table(spark, sf_dir, "topic_names"))
    return fitted.posteriors().groupBy("topic").agg(F.count("*").alias("articles"), F.avg("share").alias("mean_share"), F.avg("posterior").alias("mean_posterior"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities with counts, lift and corrected odds ratio."""
    pairs = pair_counts(table(spark, sf_dir, "article_entities"), "processed_article_id", "entity_id")
    return pairs.select("a", "b", "n_ab", "n_a", "n_b", "n", *[F.round(c, 4).alias(c) for c in ("lift", "odds_ratio", "log_odds")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_counts(table(spark, sf_dir, "article_entities"), "processed_article_id", "entity_id").select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, sf_dir, "raw_articles")).distinct()


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main body."""
    return boilerplate.bodies(table(spark, sf_dir, "raw_articles"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_values(table(spark, sf_dir, "raw_articles"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts each field."""
    return truncation.cut_shares(table(spark, sf_dir, "raw_articles"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = RepeatedLines(spark)
    state.merge(table(spark, sf_dir, "raw_articles"))
    return state.found()


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines repeated in its source."""
    state = RepeatedLines(spark)
    articles = table(spark, sf_dir, "raw_articles")
    state.merge(articles)
    return state.rebuild(articles)


def p7_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines when the articles arrive in three deltas, the last of which brings those of source 7 once more."""
    path = scratch_path(spark, "lines")
    articles = table(spark, sf_dir, "raw_articles").withColumn("arrival", F.pmod(F.xxhash64("id"), F.lit(3)))
    for n in range(3):
        due = F.col("arrival") == n
        RepeatedLines(spark, path).merge(articles.filter(due | (F.col("source_id") == 7) if n == 2 else due))
    return RepeatedLines(spark, path).found()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item, in how many documents it leaks."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed records, one row a copy."""
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).records()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.assign(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by reading level."""
    return reading.profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def queries() -> dict:
    return {name: fn for name, fn in globals().items() if name.startswith("p") and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
