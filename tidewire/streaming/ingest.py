"""Micro-batches: ingest with the store's unbounded key check, and hourly windows with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.store import TableStore, keep_first


def ingest_stream(stream: DataFrame, store: TableStore, name: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, most: int = 32) -> StreamingQuery:
    """Appends what is new by key, over all time: each batch is anti-joined to the stored keys and only its new rows are written.
    A batch that is run again after a failure finds its rows stored and adds none. More than ``most`` parts are compacted."""

    def batch(rows: DataFrame, number: int) -> None:
        new = keep_first(rows, keys, [F.col(c) for c in order])
        if store.version(name):
            new = new.join(store.read(name).select(*keys), list(keys), "left_anti").select(*rows.columns)
        store.append(name, new)
        store.compact(name, most)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_windows(stream: DataFrame, ts: str, keys: Sequence[str] = (), late: str = "5 minutes") -> DataFrame:
    """Counts per hour (and keys); an hour is final once the watermark has passed its end."""
    rows = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    per = rows.groupBy(F.window("_at", "1 hour"), *keys).agg(F.count("*").alias("cnt"))
    return per.select(F.col("window.start").alias("hour"), *keys, "cnt")


def file_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)
