"""Sources by name, and one call from a source to the store."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.store import TableStore, keep_first
from tidewire.session import written


@dataclass(frozen=True)
class Source:
    """``read(spark, **options)`` gives items; ``convert(items)`` gives a column ``row`` (a struct of the stored columns, null where
    the item cannot be converted) beside them; ``valid`` is an SQL condition on ``row``."""

    read: Callable[..., DataFrame]
    convert: Callable[[DataFrame], DataFrame]
    valid: str = "true"
    options: dict = field(default_factory=dict)


class Registry:
    def __init__(self):
        self._sources: dict[str, Source] = {}

    def add(self, name: str, source: Source) -> None:
        self._sources[name] = source

    def get(self, name: str) -> Source:
        if name not in self._sources:
            raise ValueError(f"unknown source: {name}; known: {', '.join(sorted(self._sources))}")
        return self._sources[name]

    def options(self, name: str, overrides: dict | None = None) -> dict:
        """The source's options, with those overrides whose names it knows."""
        known = self.get(name).options
        return {**known, **{k: v for k, v in (overrides or {}).items() if k in known}}


def ingest(spark: SparkSession, registry: Registry, name: str, store: TableStore, target: str, keys: Sequence[str], order: Sequence[str], overrides: dict | None = None) -> DataFrame:
    """Reads, converts and stores; returns one row: total_rows, saved, skipped (stored before, or equal to an earlier row),
    errors (not convertible or not valid; they do not stop the others). Only the new rows are written."""
    source = registry.get(name)
    items = source.convert(source.read(spark, **registry.options(name, overrides)))
    items = written(items.select("row", F.expr(f"coalesce(row is not null and ({source.valid}), false)").alias("good")), "items")
    rows = keep_first(items.filter("good").select("row.*"), keys, [F.col(c) for c in order])
    if store.version(target):
        rows = rows.join(store.read(target).select(*keys), list(keys), "left_anti").select(*rows.columns)
    store.append(target, rows)
    saved = spark.read.parquet(f"{store.root}/{target}/{store.parts(target)[-1]}").agg(F.count("*").alias("saved"))
    stats = items.agg(F.count("*").alias("total_rows"), F.count_if(~F.col("good")).alias("errors")).join(F.broadcast(saved))  # a row each
    return stats.select("total_rows", "saved", (F.col("total_rows") - F.col("saved") - F.col("errors")).alias("skipped"), "errors")
