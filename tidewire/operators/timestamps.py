"""Mixed timestamp notations and zones to one UTC instant.

Method: each source's missing zone is estimated by aligning its zoneless wall clocks with the times the
rows were ingested. A value cannot be later than its ingestion, and most are ingested soon after; so for
each source and candidate zone (an IANA zone stands for its whole offset history) two figures count:
the values that would lie after ingestion (violations) and the values ingested within a freshness window
(support). The candidate with the fewest violations, then the most support, is the estimate. Candidates are all distinct
offset histories of the zone table over the years of the data. All rows count; the aggregate per (source, candidate)
is a few numbers, so the shuffle is independent of row size.

A zone the source itself declares is taken where it is a known IANA name (it is part of the data's
definition); the estimate fills in where none is declared, and the report shows both, with the declared
zone's own violations, so a wrong declaration is visible.

Defined results: null, empty, impossible (30 February, 25:71) and meaningless values give no row; repeated
rows give one row per id; rows of sources that are unknown use ``default_zone``; an empty table gives no rows.
Extra columns are ignored: only the named ones are read.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.timeparse import known_zones, to_utc_us, with_instant, with_parts, with_wall
from tidewire.session import written

DEFAULT_ZONE = "Europe/Moscow"
#: Zones that stand first among those of equal history and equal figures. A parameter.
PREFERRED = (
    "Europe/Moscow", "UTC", "Europe/London", "Europe/Berlin", "Europe/Kaliningrad", "Europe/Samara", "Asia/Yekaterinburg",
    "Asia/Omsk", "Asia/Novosibirsk", "Asia/Irkutsk", "Asia/Yakutsk", "Asia/Vladivostok", "Asia/Magadan", "Asia/Kamchatka",
    "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo", "America/New_York", "America/Chicago", "America/Los_Angeles",
)


@lru_cache(maxsize=32)
def offset_histories(first: int, last: int, preferred: tuple[str, ...] = PREFERRED) -> tuple[str, ...]:
    """One zone of the zone table for each history of offsets from the year ``first`` to the year ``last``: the preferred one
    of a history, else the first by name. A history is read at each week's noon: changes of offset lie further apart."""
    rank = {z: k for k, z in enumerate(preferred)}
    start = datetime(first, 1, 1, 12)
    times = [start + timedelta(days=7 * k) for k in range((last - first + 1) * 53)]
    found: dict[tuple, str] = {}
    for zone in sorted(set(known_zones().values()), key=lambda z: (rank.get(z, len(rank)), z)):
        info = zoneinfo.ZoneInfo(zone)
        found.setdefault(tuple(info.utcoffset(t) for t in times), zone)
    return tuple(found.values())


def _known(name: Column) -> Column:
    zones = known_zones()
    return F.when(name.isin(*sorted(set(zones.values()))), name)


def read_values(rows: DataFrame, key: str, value: str, source: Column, ingested: Column) -> DataFrame:
    """The parsed form (id, source, ingested, _p_*) of the rows that have an id and a value: numbers only, no text."""
    rows = rows.select(F.col(key).cast("long").alias("id"), source.alias("source"), ingested.cast("timestamp").alias("ingested"), F.col(value).alias("value"))
    return with_parts(rows.filter("id is not null and value is not null"), "value").drop("value").filter("_p_kind is not null")


def estimate_zones(parsed: DataFrame, candidates: Sequence[str] | None = None, fresh_minutes: int = 180) -> DataFrame:
    """(source, zone, n, violations, fresh): the best candidate zone of each source, from its zoneless values.

    ``parsed`` comes from :func:`read_values`. Candidates are the distinct offset histories over the years of ingestion.
    Sources without a zoneless readable value have no row. Ties go to the earlier candidate.
    """
    if candidates is None:
        years = parsed.filter("source is not null").agg(F.min(F.year("ingested")), F.max(F.year("ingested"))).first()
        candidates = offset_histories(max(years[0] or 2000, 1970), min(years[1] or 2000, 2037))
    loose = parsed.filter("source is not null and ingested is not null and _p_kind = 'date' and _p_offset_min is null and _p_zone is null")
    loose = with_wall(loose.withColumn("utc", F.lit("UTC")), "utc", "ingested")
    loose = loose.select("source", F.col("_wall").alias("w"), F.unix_micros("ingested").alias("i")).filter("w is not null")
    rows = loose.select("source", "w", "i", F.posexplode(F.array(*[F.lit(z) for z in candidates])).alias("k", "zone"))
    lag = F.col("i") - to_utc_us(F.col("w"), F.col("zone"))
    per = rows.groupBy("source", "k", "zone").agg(F.count("*").alias("n"), F.count_if(lag < 0).alias("violations"), F.count_if(lag.between(0, fresh_minutes * 60_000_000)).alias("fresh"))
    # A row a source and candidate.
    best = F.min(F.struct("violations", (-F.col("fresh")).alias("not_fresh"), "k", "zone", "n", "fresh"))
    return per.groupBy("source").agg(best.alias("b")).select("source", "b.zone", "b.n", "b.violations", "b.fresh")


def normalise(parsed: DataFrame, zone: Column) -> DataFrame:
    """(id, epoch_us): one row per id whose value names a valid instant; ``zone`` counts for zoneless values."""
    return with_instant(parsed.withColumn("_zone", zone), "_zone", "ingested", "epoch_us").select("id", "epoch_us").filter("epoch_us is not null")


def source_zones(parsed: DataFrame, sources: DataFrame, default_zone: str = DEFAULT_ZONE) -> DataFrame:
    """(source, declared, estimated, zone, n, violations, fresh): the zone in use for each source."""
    declared = sources.select(F.col("id").alias("source"), _known(F.get_json_object("meta_info", "$.tz")).alias("declared")).filter("source is not null")
    declared = declared.groupBy("source").agg(F.min("declared").alias("declared"))
    both = declared.join(estimate_zones(parsed).withColumnRenamed("zone", "estimated"), "source", "full_outer")
    return both.withColumn("zone", F.coalesce("declared", "estimated", F.lit(default_zone)))


def read_articles(articles: DataFrame) -> DataFrame:
    """raw_articles.published_at parsed once, as a written table of numbers: the estimate and the conversion read it."""
    return written(read_values(articles, "id", "published_at", F.col("source_id"), F.col("retrieved_at")), "published_at")


def article_instants(articles: DataFrame, sources: DataFrame, default_zone: str = DEFAULT_ZONE) -> DataFrame:
    """(id, epoch_us) of raw_articles.published_at."""
    parsed = read_articles(articles)
    zones = source_zones(parsed, sources, default_zone).select(F.col("source").alias("_source"), F.col("zone").alias("_declared"))
    # One row per source: a dimension that Spark's own size threshold may broadcast; else a shuffle join with AQE's skew handling.
    return normalise(parsed.join(zones, F.col("source") == F.col("_source"), "left"), F.coalesce("_declared", F.lit(default_zone)))


def summary_instants(summaries: DataFrame, default_zone: str = DEFAULT_ZONE) -> DataFrame:
    """(id, epoch_us) of summarizations.period_start; these have no source, so the default zone counts."""
    parsed = read_values(summaries, "id", "period_start", F.lit(None).cast("int"), F.col("created_at"))
    return normalise(parsed, F.lit(default_zone))


def all_instants(articles: DataFrame, sources: DataFrame, summaries: DataFrame) -> DataFrame:
    """(tbl, id, epoch_us), distinct."""
    a = article_instants(articles, sources).select(F.lit("raw_articles").alias("tbl"), "id", "epoch_us")
    s = summary_instants(summaries).select(F.lit("summarizations").alias("tbl"), "id", "epoch_us")
    return a.unionByName(s).groupBy("tbl", "id").agg(F.min("epoch_us").alias("epoch_us"))
