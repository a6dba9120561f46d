"""Time buckets in an explicit zone, without a session-zone or a current-time dependence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_hour(ts: Column, tz: str) -> Column:
    """The hour bucket of an instant (stored as UTC wall clock, timestamp_ntz) in a zone, as timestamp_ntz."""
    return F.date_trunc("hour", F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))).cast("timestamp_ntz")


def utc_bound(local_text: str, tz: str) -> Column:
    """The UTC wall clock of a local bound: the constant goes to UTC, so the column stays bare and the range is pushed down."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), F.lit(local_text).cast("timestamp_ntz"))


def to_zone(ts: Column, tz: str) -> Column:
    """The wall clock of an instant (UTC wall clock, timestamp_ntz) in a zone; null stays null."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def from_zone(wall: Column, tz: str) -> Column:
    """The instant, as UTC wall clock, of a wall clock in a zone; null stays null."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), wall.cast("timestamp_ntz"))


NO_DATE = "Дата неизвестна"


def display_date(wall: Column, with_time: bool = True) -> Column:
    """Day, month and year, with hour and minute where asked for; a fixed text for no date."""
    return F.coalesce(F.date_format(wall, "dd.MM.yyyy HH:mm" if with_time else "dd.MM.yyyy"), F.lit(NO_DATE))


def hour_spine(spark: SparkSession, last_hour: str, hours: int = 24) -> DataFrame:
    """``hours`` consecutive hour buckets ending with ``last_hour``, as timestamp_ntz column ``hour``."""
    end = F.lit(last_hour).cast("timestamp_ntz")
    return spark.range(1).select(F.explode(F.sequence(end - F.expr(f"INTERVAL {hours - 1} HOURS"), end, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
