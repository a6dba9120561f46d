"""Queries of mixed timestamp notations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import timestamps as ops
from tidewire.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.all_instants(table(spark, sf_dir, "raw_articles"), table(spark, sf_dir, "sources"), table(spark, sf_dir, "summarizations"))


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and estimated zone of each source, with the estimate's violations."""
    parsed = ops.read_articles(table(spark, sf_dir, "raw_articles"))
    return ops.source_zones(parsed, table(spark, sf_dir, "sources"))


def p2_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as p2_found with every declared zone hidden: zoneless values are converted by the estimate alone."""
    hidden = table(spark, sf_dir, "sources").withColumn("meta_info", F.lit(None).cast("string"))
    return ops.all_instants(table(spark, sf_dir, "raw_articles"), hidden, table(spark, sf_dir, "summarizations"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, cnt, equal): how many instants the estimate alone gives as the declared zones do."""
    known, alone = p2_found(spark, sf_dir), p2_estimated(spark, sf_dir).withColumnRenamed("epoch_us", "alone_us")
    return known.join(alone, ["tbl", "id"], "left").groupBy("tbl").agg(F.count("*").alias("cnt"), F.count_if(F.col("epoch_us") == F.col("alone_us")).alias("equal"))


QUERIES = {f.__name__: f for f in (p2_found, p2_zones, p2_estimated, p2_agreement)}
SQL: dict[str, str] = {}
