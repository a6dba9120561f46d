"""Text functions, landed documents, JSON, roll-ups and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import text as t
from tidewire.functions.markup import clean_html, page_parts
from tidewire.functions.replies import parse_entities, parse_summary
from tidewire.functions.timeparse import with_instant, with_parts
from tidewire.functions.timeutil import to_zone
from tidewire.operators import extract, summaries
from tidewire.session import table
from tidewire.sources.landed import valid_item

TZ = "Europe/Moscow"


def whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(t.squeeze(F.col("text"))).alias("squeezed"))


def truncated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's cuts and the display's shortenings."""
    a = table(spark, sf_dir, "raw_articles")
    return a.select("id", t.cut(F.col("raw_title"), 40).alias("cut_title"), t.cut_with_mark(F.col("raw_title"), 40).alias("marked"), t.shorten(F.col("raw_title"), 40).alias("short"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "raw_articles")
    return a.select("id", t.article_id(F.lit("src"), F.col("url")).alias("article_id"), t.post_id("post", F.col("id").cast("string"), F.col("published_at"), F.col("raw_text")).alias("post_id"))


def post_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles made of texts, authors and no tickers."""
    a = table(spark, sf_dir, "raw_articles").filter("raw_html is null")
    none = F.array().cast("array<string>")
    return a.select("id", t.post_title(F.col("raw_text"), F.coalesce("author", F.lit("Аноним")), none).alias("title"))


def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "raw_articles").filter("raw_text is not null")
    return a.select("id", F.md5(t.drop_noise_lines(F.col("raw_text"))).alias("kept"))


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").select("id", t.canonical_name(F.col("normalized_name")).alias("name"))


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "raw_articles")
    return a.select("id", t.escape_html(F.coalesce("raw_title", F.lit(""))).alias("html"), t.escape_markdown(F.col("raw_title")).alias("markdown"))


def valid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "raw_articles")
    return a.select("id", valid_item(F.col("url"), F.col("raw_title"), F.col("raw_text")).alias("valid"))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned titles and texts of all articles: HTML, datelines and white space."""
    c = extract.clean_articles(table(spark, sf_dir, "raw_articles"), table(spark, sf_dir, "sources"))
    return c.select("id", "title", F.length("text").alias("letters"))


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, content length and publication time of every page."""
    a = table(spark, sf_dir, "raw_articles").filter("raw_html is not null").select("id", page_parts("raw_html").alias("p"))
    return a.select("id", F.col("p.title").alias("title"), F.length("p.content").alias("letters"), F.col("p.published").alias("published"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "raw_articles").filter("raw_html is not null")
    return a.select("id", F.length(clean_html("raw_html")).alias("letters"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")).alias("k"), F.count("*").alias("cnt"))


def rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open JSON documents: how often each rubric is stated; bad or missing documents count as none."""
    a = table(spark, sf_dir, "raw_articles")
    rubric = F.try_variant_get(F.try_parse_json("meta_info"), "$.rubric", "string")
    return a.groupBy(F.coalesce(rubric, F.lit("(none)")).alias("rubric")).agg(F.count("*").alias("cnt"))


def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made from each link's entity, with a fence, a bad type and a repeated item: what is left of them."""
    e = table(spark, sf_dir, "entities").select(F.col("id").alias("entity_id"), "normalized_name", "type")
    item = lambda kind: F.struct(F.col("normalized_name").alias("mention"), F.col("normalized_name").alias("canonical"), kind.alias("type"), F.lit("key").alias("importance"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.array(item(F.col("type")), item(F.lit("planet")), item(F.col("type")))), F.lit("\n```"))
    rows = e.select("entity_id", F.concat_ws(" и ", "normalized_name", "normalized_name").alias("text"), reply.alias("reply"))
    return parse_entities(rows).select("entity_id", "normalized_name", "entity_type", "count", "importance_score")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants written in six notations and read back: how many come out equal."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    forms = {"iso": "yyyy-MM-dd'T'HH:mm:ss'Z'", "dotted": "dd.MM.yyyy HH:mm:ss 'UTC'", "slashed": "dd/MM/yyyy HH:mm:ss '+0000'", "compact": "yyyyMMdd'T'HHmmss'Z'", "plain": "yyyy-MM-dd HH:mm:ss '+00'", "mail": "EEE, dd MMM yyyy HH:mm:ss '+0000'"}
    rows = e.select("ts", F.explode(F.array(*[F.struct(F.lit(n).alias("form"), F.date_format("ts", f).alias("value")) for n, f in forms.items()])).alias("x")).select("ts", "x.form", "x.value")
    rows = with_instant(with_parts(rows.withColumn("tz", F.lit(TZ)).withColumn("now", F.lit(None).cast("timestamp")), "value"), "tz", "now", "us")
    true_us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return rows.groupBy("form").agg(F.count("*").alias("cnt"), F.count_if(F.col("us") == true_us).alias("equal"))


#: The months as dates name them.
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()


def russian_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall clocks of Moscow with the month in words, read back: how many come out equal, to the minute."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"))
    wall = to_zone(F.col("ts"), TZ)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(wall))
    day = F.concat(F.date_format(wall, "d "), month, F.date_format(wall, " yyyy"))
    forms = {"time first": F.concat(F.date_format(wall, "HH:mm, "), day), "day first": F.concat(day, F.date_format(wall, " г., HH:mm"))}
    rows = e.select("ts", F.explode(F.array(*[F.struct(F.lit(n).alias("form"), v.alias("value")) for n, v in forms.items()])).alias("x")).select("ts", "x.form", "x.value")
    rows = with_instant(with_parts(rows.withColumn("tz", F.lit(TZ)).withColumn("now", F.lit(None).cast("timestamp")), "value"), "tz", "now", "us")
    true_us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return rows.groupBy("form").agg(F.count("*").alias("cnt"), F.count_if(F.col("us") == true_us).alias("equal"))


def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "summarizations")
    return s.select("id", summaries.cost(F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost"))


def cost_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "summarizations").groupBy("model_used")
    tokens = F.sum(F.col("prompt_tokens") + F.col("completion_tokens"))
    return s.agg(tokens.alias("tokens"), F.round(tokens * 0.07 / 1e6, 6).alias("low"), F.round(tokens * 0.20 / 1e6, 6).alias("high"))


def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with at least three events, with their numbers of events and users."""
    return summaries.hourly_counts(table(spark, sf_dir, "events"), "ts", "user_id", TZ)


def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days over the hourly summaries: the ordered text (by its hash) and its hours."""
    s = table(spark, sf_dir, "summarizations").filter("period_type = 'hour' and content is not null")
    ntz = F.timestamp_add("SECOND", F.unix_seconds("period_end").cast("int"), F.lit("1970-01-01").cast("timestamp_ntz"))
    w = Window.partitionBy("hour").orderBy(F.desc("id"))
    rows = s.select("id", ntz.alias("hour"), "content").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return summaries.daily_rollup(rows).select("day", F.md5("text").alias("text_md5"), "hours")


def brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "summarizations")
    return summaries.brief(s, "2026-01-02 00:00:00Z", 168).select("id", "line")


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "summarizations").filter("period_type = 'day'")
    return s.select("id", F.md5(summaries.digest(F.col("content"))).alias("text_md5"))


def summary_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored contents written as replies and read back; one in three is no JSON and becomes a plain summary."""
    s = table(spark, sf_dir, "summarizations").filter("content is not null")
    reply = F.when(F.col("id") % 3 == 0, F.col("content.summary")).otherwise(F.to_json("content"))
    out = s.select("id", parse_summary(reply).alias("c"))
    return out.select("id", F.size("c.topics").alias("topics"), F.md5(F.coalesce("c.summary", F.lit(""))).alias("summary_md5"))


def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product of every vector with the first: one broadcast row."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return v.join(F.broadcast(q)).select("vec_id", F.round(dot, 4).alias("dot"))


def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in engine over all processed articles with the names of all sources (a fixed table): mentions per name."""
    names = {r[0]: "organization" for r in table(spark, sf_dir, "sources").select("name").collect()}
    articles = table(spark, sf_dir, "processed_articles").select("id", "title", "text")
    found = extract.extract(articles, "gazetteer", names=names).filter("error is null")
    return found.groupBy("normalized_name", "entity_type").agg(F.count("*").alias("mentions"), F.count_distinct("article_id").alias("articles"))


QUERIES = {f.__name__: f for f in (whitespace, truncated_columns, ids, post_titles, noise_lines, canonical_names, escaped, valid_items, clean_pages, page_extract, html_text, json_props, rubrics, reply_parse, dates, russian_dates, cost, cost_band, hourly_rollup, daily_rollup, brief, digests, summary_replies, vector_dot, extraction)}
SQL = {
    "whitespace": r"select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x{85}\x{0B}\x{1c}-\x{1f}]+', ' ', 'g'))) as squeezed from documents",
    "truncated_columns": """
select id, substr(raw_title, 1, 40) as cut_title, case when length(raw_title) > 40 then substr(raw_title, 1, 40) || '...' else raw_title end as marked,
  case when length(coalesce(raw_title, '')) <= 40 then coalesce(raw_title, '') else trim(substr(raw_title, 1, 37)) || '...' end as short from raw_articles""",
    "ids": """
select id, 'src_' || substr(md5(url), 1, 12) as article_id, 'post_' || substr(sha256(cast(id as varchar) || '|' || coalesce(published_at, '') || '|' || substr(coalesce(raw_text, ''), 1, 100)), 1, 16) as post_id from raw_articles""",
    "post_titles": """
with a as (select id, raw_text as t, coalesce(author, 'Аноним') as au, string_split(trim(raw_text, ' '), chr(10))[1] as line, string_split(raw_text, '.')[1] as sentence from raw_articles where raw_html is null),
b as (select *, case when length(line) > length(sentence) then line else sentence end as longer from a),
c as (select *, trim(case when length(longer) < 20 then substr(t, 1, 100) else longer end, ' ') as title from b),
d as (select *, case when au <> '' and au <> 'Аноним' then au || ': ' || title else title end as full_title from c)
select id, case when coalesce(t, '') = '' then 'Без заголовка' when length(full_title) > 200 then substr(full_title, 1, 200) || '...' else full_title end as title from d""",
    "noise_lines": r"""
select id, md5(regexp_replace(array_to_string(list_filter(string_split(raw_text, chr(10)), lambda x: not (contains(lower(x), 'оставайтесь на связи') or contains(lower(x), 'читайте рбк')
  or contains(lower(x), 'рбк в «максе»') or contains(lower(x), 'рбк в max') or contains(lower(x), 'материал дополняется') or contains(lower(x), '[ рбк ]'))), chr(10)), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as kept
from raw_articles where raw_text is not null""",
    "canonical_names": "select id, upper(substr(translate(normalized_name, 'ёЁ', 'еЕ'), 1, 1)) || substr(translate(normalized_name, 'ёЁ', 'еЕ'), 2) as name from entities",
    "escaped": r"""
select id, replace(replace(replace(coalesce(raw_title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html,
  regexp_replace(coalesce(raw_title, ''), '([_*\[\]()~`>#+\-=|{}.!\\])', '\\\1', 'g') as markdown from raw_articles""",
    "clean_pages": r"""
select id, trim(regexp_replace(coalesce(raw_title, ''), '[\s\p{Z}\x{85}\x{0B}\x{1c}-\x{1f}]+', ' ', 'g')) as title,
  cast(length(trim(regexp_replace(coalesce(raw_text, ''), '[\s\p{Z}\x{85}\x{0B}\x{1c}-\x{1f}]+', ' ', 'g'))) as integer) as letters from raw_articles""",
    "extraction": """
with n as (select distinct name from sources where name is not null),
a as (select id, case when coalesce(title, '') <> '' then title || chr(10) || coalesce(text, '') else coalesce(text, '') end as whole from processed_articles),
m as (select n.name, a.id, (length(whole) - length(replace(whole, n.name, ''))) // length(n.name) as k from a join n on contains(a.whole, n.name))
select name as normalized_name, 'organization' as entity_type, cast(sum(k) as bigint) as mentions, count(*) as articles from m group by 1""",
    "russian_dates": "select 'time first' as form, count(*) as cnt, count(*) as equal from events union all select 'day first', count(*), count(*) from events",
    "valid_items": "select id, coalesce(regexp_matches(url, '^https?://') and length(trim(raw_title, ' ')) >= 3 and length(raw_text) >= 50, false) as valid from raw_articles",
    "json_props": "select event_type, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k, count(*) as cnt from events group by 1",
    "rubrics": "select coalesce(json_extract_string(meta_info, '$.rubric'), '(none)') as rubric, count(*) as cnt from raw_articles group by 1",
    "reply_parse": """
select id as entity_id, trim(normalized_name) as normalized_name, type as entity_type,
  cast(greatest(1, (length(lower(normalized_name || ' и ' || normalized_name)) - length(replace(lower(normalized_name || ' и ' || normalized_name), lower(trim(normalized_name)), ''))) / length(trim(normalized_name))) as integer) as count,
  cast(0.7 as double) as importance_score
from entities where trim(normalized_name) <> '' and type in ('person', 'organization', 'location', 'event', 'concept')""",
    "dates": "select f as form, count(*) as cnt, count(*) as equal from events, (select unnest(['iso', 'dotted', 'slashed', 'compact', 'plain', 'mail']) as f) group by 1",
    "cost": "select id, round(prompt_tokens / 1e6 * 0.14 + completion_tokens / 1e6 * 0.28, 6) as cost from summarizations",
    "cost_band": """
select model_used, cast(sum(prompt_tokens + completion_tokens) as bigint) as tokens, round(sum(prompt_tokens + completion_tokens) * 0.07 / 1e6, 6) as low,
  round(sum(prompt_tokens + completion_tokens) * 0.20 / 1e6, 6) as high from summarizations group by 1""",
    "hourly_rollup": """
select * from (select date_trunc('hour', ts + interval 3 hour) as hour, count(*) as articles_count, count(distinct user_id) as sources_count from events group by 1) where articles_count >= 3""",
    "daily_rollup": """
with r as (select *, row_number() over (partition by epoch_us(period_end) order by id desc) as rn from summarizations where period_type = 'hour' and content is not null),
l as (select make_timestamp(epoch_us(period_end)) as moment, strftime(make_timestamp(epoch_us(period_end)), '%H:%M') || ': ' || coalesce(content.summary, '') || ' (' || array_to_string(list_slice(coalesce(content.topics, []), 1, 3), ', ') || ')' as line from r where rn = 1)
select cast(moment as date) as day, md5(string_agg(line, chr(10) order by moment)) as text_md5, cast(count(*) as integer) as hours from l group by 1""",
    "brief": """
select id, coalesce(content.summary, 'Нет данных') as line from summarizations where period_type = 'hour'
and epoch_us(period_end) between epoch_us(timestamp '2025-12-26 00:00:00') and epoch_us(timestamp '2026-01-02 00:00:00') order by period_end desc, id desc limit 12""",
    "digests": """
select id, md5(case when content is null then 'Нет данных' else coalesce(content.summary, '') || chr(10) || array_to_string(list_slice(coalesce(content.topics, []), 1, 3), ', ')
  || case when coalesce(content.trend, '') <> '' then chr(10) || content.trend else '' end end) as text_md5 from summarizations where period_type = 'day'""",
    "summary_replies": """
select id, cast(case when id % 3 = 0 then 0 else coalesce(len(content.topics), -1) end as integer) as topics,
  md5(case when id % 3 = 0 then substr(coalesce(content.summary, ''), 1, 500) else coalesce(content.summary, '') end) as summary_md5 from summarizations where content is not null""",
    "vector_dot": """
select v.vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double))), 4) as dot
from embeddings v, (select embedding from embeddings where vec_id = 0) q""",
}
