"""Table changes: inserts, upserts, status changes, and streams over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import store
from tidewire.operators.store import TableStore, insert_ignore, keep_first, keep_last, reset_status, set_status, upsert
from tidewire.session import scratch_path, table
from tidewire.streaming.ingest import file_stream, hourly_windows, ingest_stream


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_articles").select("id", "url", "source_id", "status")


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of each url."""
    return keep_first(_articles(spark, sf_dir), ["url"], [F.col("id")])


def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_last(_articles(spark, sf_dir), ["url"], "id").select("id", "url", "source_id", "status")


def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the articles are stored, all come in: what the store holds afterwards."""
    a = _articles(spark, sf_dir)
    old = keep_first(a.filter("id % 2 = 0"), ["url"], [F.col("id")])
    return insert_ignore(old, a, ["url"], [F.col("id")])[0]


def insert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    old = keep_first(a.filter("id % 2 = 0"), ["url"], [F.col("id")])
    return insert_ignore(old, a, ["url"], [F.col("id")])[1]


def upsert_keep_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed articles come in again: only processed_at is refreshed, id and title stay."""
    p = table(spark, sf_dir, "processed_articles").select("id", "raw_article_id", "title", F.unix_micros("processed_at").alias("at_us"))
    new = p.select((F.col("id") + 1_000_000).alias("id"), "raw_article_id", F.upper("title").alias("title"), (F.col("at_us") + 1).alias("at_us")).filter("raw_article_id % 3 = 0")
    return upsert(p.filter("raw_article_id % 2 = 0"), new, ["raw_article_id"], ["at_us"])


def upsert_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly roll-ups of two overlapping event ranges: the later payload wins, the first id stays."""
    e = table(spark, sf_dir, "events")
    roll = lambda f, base: e.filter(f).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("cnt"), (F.min("event_id") + base).alias("id")).select("id", "hour", "cnt")
    return upsert(roll("ts < timestamp_ntz'2024-01-20 00:00:00'", 0), roll("ts >= timestamp_ntz'2024-01-10 00:00:00' and event_type <> 'error'", 1_000_000), ["hour"], ["cnt"])


def status_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    done = table(spark, sf_dir, "processed_articles").select(F.col("raw_article_id").alias("id"), F.lit("done").alias("status"))
    return set_status(a, done).groupBy("status").agg(F.count("*").alias("cnt"))


def status_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reset_status(_articles(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("cnt"))


def cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose entity is stored (the rest is what a cascade deletes)."""
    return store.cascade(table(spark, sf_dir, "article_entities"), table(spark, sf_dir, "entities"), "entity_id").select("id", "entity_id")


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that break a constraint, by constraint."""
    rules = [store.Rule("title", F.length(F.trim("raw_title")) > 0), store.Rule("source", F.col("source_id").isNotNull()), store.Rule("status", F.col("status").isin("raw", "processed", "failed"))]
    _, bad = store.validate(table(spark, sf_dir, "raw_articles"), rules)
    return bad.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count("*").alias("cnt"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as a file stream into the store: what is stored is one article a url."""
    root = scratch_path(spark, "stream")
    source = _articles(spark, sf_dir)
    source.repartition(3, "id").write.parquet(f"{root}/landed")
    kept = TableStore(spark, f"{root}/store")
    stream = file_stream(spark, f"{root}/landed", source, "*.parquet", 2)
    ingest_stream(stream, kept, "articles", ["url"], ["id"], f"{root}/checkpoint").awaitTermination()
    return kept.read("articles").select("url")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours the watermark has closed when all events have streamed by: eight files of a batch, each sorted by time."""
    root = scratch_path(spark, "hours")
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    events.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(f"{root}/landed")
    hours = hourly_windows(file_stream(spark, f"{root}/landed", events, "*.parquet", 8), "ts")
    q = hours.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("hour timestamp, cnt bigint").parquet(f"{root}/out").select(F.unix_micros("hour").alias("hour_us"), "cnt")


QUERIES = {f.__name__: f for f in (dedup_keep_first, dedup_keep_last, insert_new, insert_stats, upsert_keep_id, upsert_payload, status_transition, status_reset, cascades, rejected_rows, stream_dedup, stream_hourly)}
SQL = {
    "dedup_keep_first": "select id, url, source_id, status from (select *, row_number() over (partition by url order by id) as rn from raw_articles) where rn = 1",
    "dedup_keep_last": "select id, url, source_id, status from (select *, row_number() over (partition by url order by id desc) as rn from raw_articles) where rn = 1",
    "insert_new": """
select id, url, source_id, status from (select *, row_number() over (partition by url order by id % 2, id) as rn,
  min(id % 2) over (partition by url) as odd, row_number() over (partition by url order by id) as first from raw_articles) where rn = 1""",
    "insert_stats": """
with fresh as (select url from raw_articles group by 1 having min(id % 2) = 1)
select count(*) as total_rows, (select count(*) from fresh) as saved, count(*) - (select count(*) from fresh) as skipped, cast(0 as bigint) as errors from raw_articles""",
    "upsert_keep_id": """
select case when raw_article_id % 2 = 0 then id else id + 1000000 end as id, raw_article_id, case when raw_article_id % 2 = 0 then title else upper(title) end as title,
  case when raw_article_id % 3 = 0 then epoch_us(processed_at) + 1 else epoch_us(processed_at) end as at_us
from processed_articles where raw_article_id % 2 = 0 or raw_article_id % 3 = 0""",
    "upsert_payload": """
with a as (select date_trunc('hour', ts) as hour, count(*) as cnt, min(event_id) as id from events where ts < timestamp '2024-01-20' group by 1),
b as (select date_trunc('hour', ts) as hour, count(*) as cnt, min(event_id) + 1000000 as id from events where ts >= timestamp '2024-01-10' and event_type <> 'error' group by 1)
select coalesce(a.id, b.id) as id, hour, coalesce(b.cnt, a.cnt) as cnt from a full outer join b using (hour)""",
    "status_transition": "select case when p.raw_article_id is not null then 'done' else r.status end as status, count(*) as cnt from raw_articles r left join processed_articles p on p.raw_article_id = r.id group by 1",
    "status_reset": "select case when status in ('processed', 'failed', 'processing') then 'raw' else status end as status, count(*) as cnt from raw_articles group by 1",
    "cascades": "select id, entity_id from article_entities where entity_id in (select id from entities)",
    "rejected_rows": """
with b as (select unnest(list_filter([case when not coalesce(length(trim(raw_title, ' ')) > 0, false) then 'title' end, case when source_id is null then 'source' end,
  case when not coalesce(status in ('raw', 'processed', 'failed'), false) then 'status' end], lambda x: x is not null)) as rule from raw_articles)
select rule, count(*) as cnt from b group by 1""",
    "stream_dedup": "select distinct url from raw_articles",
    "stream_hourly": """
with m as (select max(ts) - interval 5 minute as w from events)
select epoch_us(date_trunc('hour', ts)) as hour_us, count(*) as cnt from events, m where date_trunc('hour', ts) + interval 1 hour <= w group by 1""",
}
