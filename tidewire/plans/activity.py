"""Activity over time, statistics per source, and search: the interactive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import bar, grouped_number
from tidewire.functions.timeutil import hour_spine, local_hour, utc_bound
from tidewire.session import table

TZ = "Europe/Moscow"
AS_OF_HOUR = "2024-01-15 11:00:00"


def hourly_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour of the 24 hours up to the one of as_of, every hour present."""
    first = "2024-01-14 12:00:00"
    events = table(spark, sf_dir, "events").filter((F.col("ts") >= utc_bound(first, TZ)) & (F.col("event_type") != "error"))
    per = events.groupBy(local_hour(F.col("ts"), TZ).alias("hour")).agg(F.count("*").alias("cnt"))
    return hour_spine(spark, AS_OF_HOUR).join(per, "hour", "left").select("hour", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def hour_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the 7 days before as_of by local hour of the day, all 24 present."""
    events = table(spark, sf_dir, "events").filter((F.col("ts") >= utc_bound("2024-01-08 11:30:00", TZ)) & (F.col("ts") < utc_bound("2024-01-15 11:30:00", TZ)))
    per = events.groupBy(F.hour(F.convert_timezone(F.lit("UTC"), F.lit(TZ), F.col("ts").cast("timestamp_ntz"))).alias("hour")).agg(F.count("*").alias("cnt"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(per, "hour", "left").select("hour", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "raw_articles")
    return a.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("raw", "processed", "failed")],
        F.unix_micros(F.min("retrieved_at")).alias("first_us"),
        F.unix_micros(F.max("retrieved_at")).alias("last_us"),
    )


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed articles per source; sources without any keep a 0. The articles are counted before the join."""
    n = table(spark, sf_dir, "raw_articles").filter("status = 'failed'").groupBy("source_id").agg(F.count("id").alias("cnt"))
    s = table(spark, sf_dir, "sources").select("id", "name")
    return s.join(n, s["id"] == n["source_id"], "left").select("id", "name", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 newest articles whose title or text matches, failed ones left out."""
    a = table(spark, sf_dir, "raw_articles").filter((F.col("raw_title").ilike("%энергоблок%") | F.col("raw_text").ilike("%энергоблок%")) & (F.col("status") != "failed"))
    return a.orderBy(F.desc_nulls_first("retrieved_at"), F.desc("id")).limit(10).select("id", "raw_title", "url", F.unix_micros("retrieved_at").alias("at_us"))


def pending_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 oldest raw articles: the work queue's batch."""
    a = table(spark, sf_dir, "raw_articles").filter("status = 'raw'")
    return a.orderBy(F.asc_nulls_last("retrieved_at"), "id").limit(100).select("id", "source_id")


def existing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_articles").filter("source_id = 7").select("url").distinct()


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "processed_articles").filter("raw_article_id = 42").select("id", "raw_article_id", "title")


def _hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    per = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period_start")).agg(F.count("*").alias("cnt"), F.count_distinct("user_id").alias("users"))
    return per.withColumn("period_end", F.col("period_start") + F.expr("INTERVAL 1 HOUR"))


def period_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly roll-ups wholly inside a period."""
    h = _hourly_events(spark, sf_dir)
    return h.filter("period_start >= timestamp_ntz'2024-01-10 00:30:00' and period_end <= timestamp_ntz'2024-01-11 12:00:00'").select("period_start", "period_end", "cnt")


def last_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "summarizations").filter("period_type = 'hour'")
    return s.orderBy(F.desc("period_end"), F.desc("id")).limit(1).select("id", F.unix_micros("period_end").alias("end_us"), F.col("content.summary").alias("summary"))


def smart_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 newest articles of a period with a text of 200 to 5000 letters, with their source."""
    a = table(spark, sf_dir, "raw_articles")
    a = a.filter("retrieved_at between timestamp'2025-06-01 00:00:00Z' and timestamp'2025-06-30 23:59:59Z' and status <> 'failed' and length(raw_text) between 200 and 5000")
    s = table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    # The top 40 by sort keys alone, then the join: only rows with a source count, so the join comes first on the narrow side.
    return a.join(s, "source_id").orderBy(F.desc_nulls_first("retrieved_at"), F.desc("id")).limit(40).select("id", F.col("raw_title").alias("title"), "source", F.length("raw_text").alias("letters"))


def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 latest rows with their instant as epoch, UTC and local text."""
    a = table(spark, sf_dir, "raw_articles").filter("retrieved_at is not null").orderBy(F.desc("id")).limit(20)
    ntz = F.convert_timezone(F.lit("UTC"), F.lit(TZ), F.timestamp_add("SECOND", F.unix_seconds("retrieved_at").cast("int"), F.lit("1970-01-01").cast("timestamp_ntz")))
    return a.select("id", F.unix_seconds("retrieved_at").alias("epoch"), F.date_format(ntz, "yyyy-MM-dd HH:mm").alias("local"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible random sample: ten articles by the hash of their id."""
    a = table(spark, sf_dir, "raw_articles").filter("raw_text is not null and length(raw_text) >= 200")
    return a.select("id", F.md5(F.col("id").cast("string")).alias("h")).orderBy("h").limit(10)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five articles a source, by hash order."""
    a = table(spark, sf_dir, "raw_articles").filter("raw_text is not null and length(raw_text) >= 200 and source_id is not null")
    w = Window.partitionBy("source_id").orderBy(F.md5(F.col("id").cast("string")))
    return a.select("id", "source_id", F.row_number().over(w).alias("rn")).filter("rn <= 5")


def row_counts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n: table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("cnt"))
    by = table(spark, sf_dir, "raw_articles").groupBy(F.concat(F.lit("raw_articles:"), F.col("status")).alias("name")).agg(F.count("*").alias("cnt"))
    out = by
    for n in ("raw_articles", "entities", "article_entities", "processed_articles"):
        out = out.unionByName(one(n))
    return out


def pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending articles and the estimated cost of reading them."""
    n = table(spark, sf_dir, "raw_articles").filter("status = 'raw'").agg(F.count("*").alias("pending"))
    return n.select("pending", F.round(F.col("pending") * 0.0001, 4).alias("estimate"))


def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "raw_articles").filter("raw_text is not null").groupBy("source_id")
    return a.agg(F.min(F.length("raw_text")).alias("shortest"), F.floor(F.avg(F.length("raw_text"))).cast("long").alias("mean"), F.max(F.length("raw_text")).alias("longest"))


def type_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type with a bar scaled to the most frequent type."""
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("cnt"))
    top = n.agg(F.max("cnt").alias("most"))  # one row
    return n.join(F.broadcast(top)).select("event_type", grouped_number(F.col("cnt")).alias("shown"), bar(F.col("cnt"), F.col("most")).alias("bar"))


QUERIES = {f.__name__: f for f in (hourly_24h, hour_of_day, table_stats, source_counts, search_text, pending_oldest, existing_keys, point_lookup, period_containment, last_period, smart_articles, recent_rows, hash_sample, stratified_sample, row_counts_union, pending_count, next_id, length_stats, type_bars)}
SQL = {
    "hourly_24h": """
with per as (
  select date_trunc('hour', ts + interval 3 hour) as hour, count(*) as cnt from events
  where ts >= timestamp '2024-01-14 09:00:00' and event_type <> 'error' group by 1)
select s.hour, coalesce(per.cnt, 0) as cnt
from (select unnest(generate_series(timestamp '2024-01-14 12:00:00', timestamp '2024-01-15 11:00:00', interval 1 hour)) as hour) s
left join per using (hour)""",
    "hour_of_day": """
with per as (
  select cast(extract(hour from ts + interval 3 hour) as integer) as hour, count(*) as cnt from events
  where ts >= timestamp '2024-01-08 08:30:00' and ts < timestamp '2024-01-15 08:30:00' group by 1)
select cast(s.hour as integer) as hour, coalesce(per.cnt, 0) as cnt from (select unnest(range(24)) as hour) s left join per using (hour)""",
    "table_stats": """
select count(*) as total, count(*) filter (status = 'raw') as raw, count(*) filter (status = 'processed') as processed,
  count(*) filter (status = 'failed') as failed, epoch_us(min(retrieved_at)) as first_us, epoch_us(max(retrieved_at)) as last_us from raw_articles""",
    "source_counts": "select s.id, s.name, count(r.id) as cnt from sources s left join raw_articles r on r.source_id = s.id and r.status = 'failed' group by 1, 2",
    "search_text": """
select id, raw_title, url, epoch_us(retrieved_at) as at_us from raw_articles
where (raw_title ilike '%энергоблок%' or raw_text ilike '%энергоблок%') and status <> 'failed' order by retrieved_at desc nulls first, id desc limit 10""",
    "pending_oldest": "select id, source_id from raw_articles where status = 'raw' order by retrieved_at asc nulls last, id limit 100",
    "existing_keys": "select distinct url from raw_articles where source_id = 7",
    "point_lookup": "select id, raw_article_id, title from processed_articles where raw_article_id = 42",
    "period_containment": """
select * from (select date_trunc('hour', ts) as period_start, date_trunc('hour', ts) + interval 1 hour as period_end, count(*) as cnt from events group by 1, 2)
where period_start >= timestamp '2024-01-10 00:30:00' and period_end <= timestamp '2024-01-11 12:00:00'""",
    "last_period": "select id, epoch_us(period_end) as end_us, content.summary as summary from summarizations where period_type = 'hour' order by period_end desc, id desc limit 1",
    "smart_articles": """
select r.id, r.raw_title as title, s.name as source, length(r.raw_text) as letters from raw_articles r join sources s on s.id = r.source_id
where epoch_us(r.retrieved_at) between epoch_us(timestamp '2025-06-01') and epoch_us(timestamp '2025-06-30 23:59:59') and r.status <> 'failed'
  and length(r.raw_text) between 200 and 5000 order by r.retrieved_at desc nulls first, r.id desc limit 40""",
    "recent_rows": """
select id, cast(floor(epoch(retrieved_at)) as bigint) as epoch, strftime(timezone('Europe/Moscow', retrieved_at), '%Y-%m-%d %H:%M') as local
from (select * from raw_articles where retrieved_at is not null order by id desc limit 20)""",
    "hash_sample": "select id, md5(cast(id as varchar)) as h from raw_articles where raw_text is not null and length(raw_text) >= 200 order by h limit 10",
    "stratified_sample": """
select * from (select id, source_id, row_number() over (partition by source_id order by md5(cast(id as varchar))) as rn from raw_articles
where raw_text is not null and length(raw_text) >= 200 and source_id is not null) where rn <= 5""",
    "row_counts_union": """
select 'raw_articles:' || status as name, count(*) as cnt from raw_articles group by status
union all select 'raw_articles', count(*) from raw_articles union all select 'entities', count(*) from entities
union all select 'article_entities', count(*) from article_entities union all select 'processed_articles', count(*) from processed_articles""",
    "pending_count": "select count(*) as pending, round(count(*) * 0.0001, 4) as estimate from raw_articles where status = 'raw'",
    "next_id": "select coalesce(max(id), 0) + 1 as next_id from entities",
    "length_stats": """
select source_id, min(length(raw_text)) as shortest, cast(floor(avg(length(raw_text))) as bigint) as mean, max(length(raw_text)) as longest
from raw_articles where raw_text is not null group by 1""",
    "type_bars": """
with n as (select event_type, count(*) as cnt from events group by 1), m as (select *, max(cnt) over () as most from n),
b as (select *, greatest(1, cast(floor(cast(cnt as double) / cast(most as double) * 10) as integer)) as cells from m)
select event_type, replace(format('{:,}', cnt), ',', ' ') as shown, repeat('█', cells) || repeat('░', 10 - cells) as bar from b""",
}
