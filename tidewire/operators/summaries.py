"""Hourly and daily roll-ups with an injectable completion client, costs, briefs and digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.replies import parse_summary
from tidewire.functions.timeutil import local_hour

#: Prices per million tokens.
PROMPT_PRICE, COMPLETION_PRICE = 0.14, 0.28


def cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return F.round(prompt_tokens / 1e6 * PROMPT_PRICE + completion_tokens / 1e6 * COMPLETION_PRICE, 6)


def hourly_counts(posts: DataFrame, ts: str, source: str, tz: str, least: int = 3) -> DataFrame:
    """(hour, articles_count, sources_count) of the hours with at least ``least`` posts."""
    per = posts.groupBy(local_hour(F.col(ts), tz).alias("hour")).agg(F.count("*").alias("articles_count"), F.count_distinct(source).alias("sources_count"))
    return per.filter(F.col("articles_count") >= least)


def prompts(posts: DataFrame, ts: str, tz: str, title: str, text: str, source: str, most: int = 40) -> DataFrame:
    """(hour, prompt): the newest ``most`` posts of each hour as lines. The rank keeps each group bounded before it is listed."""
    rows = posts.withColumn("hour", local_hour(F.col(ts), tz))
    w = Window.partitionBy("hour").orderBy(F.col(ts).desc(), F.col(title))
    rows = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    line = F.concat(F.lit("["), F.date_format(ts, "HH:mm"), F.lit("] ["), F.coalesce(F.col(source).cast("string"), F.lit("")), F.lit("] "), F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, 300), F.lit("..."))
    listed = rows.groupBy("hour").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    return listed.select("hour", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("prompt"))


def complete(rows: DataFrame, client: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """Adds ``reply`` (null where the client fails): one call a row, in the tasks; limit them by the number of partitions."""
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf[prompt]:
                try:
                    out.append(client(p))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pdf.assign(reply=pd.Series(out, index=pdf.index, dtype="object"))

    return rows.mapInPandas(run, schema)


def summarise(posts: DataFrame, client: Callable[[str], str], ts: str, tz: str, title: str, text: str, source: str, least: int = 3) -> DataFrame:
    """(hour, content, articles_count, sources_count, prompt_tokens, completion_tokens, cost_usd) of each hour with enough posts."""
    counts = hourly_counts(posts, ts, source, tz, least)
    rows = complete(prompts(posts, ts, tz, title, text, source).join(counts, "hour"), client).filter("reply is not null")
    p, c = F.ceil(F.length("prompt") / 4).cast("int"), F.ceil(F.length("reply") / 4).cast("int")
    return rows.select("hour", parse_summary(F.col("reply")).alias("content"), "articles_count", "sources_count", p.alias("prompt_tokens"), c.alias("completion_tokens"), cost(p, c).alias("cost_usd"))


def with_meta(content: Column, model: str, posts: Column) -> Column:
    """A summary document with what made it: the model and the number of posts."""
    return F.struct(content["topics"].alias("topics"), content["summary"].alias("summary"), content["trend"].alias("trend"), content["important_events"].alias("important_events"), F.struct(F.lit(model).alias("model"), posts.alias("posts")).alias("_meta"))


def summarise_new(stored: DataFrame, posts: DataFrame, client: Callable[[str], str], ts: str, tz: str, title: str, text: str, source: str, least: int = 3) -> DataFrame:
    """Summaries (hour, content, ...) of the hours that ``stored`` (hour, content) has none of. The prompt of an hour opens with the
    summary of the hour before, where there is one."""
    rows = posts.withColumn("_hour", local_hour(F.col(ts), tz))
    rows = rows.join(stored.select(F.col("hour").alias("_hour")).distinct(), "_hour", "left_anti").drop("_hour")
    counts = hourly_counts(rows, ts, source, tz, least)
    before = stored.select((F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("hour"), F.col("content.summary").alias("before"))
    made = prompts(rows, ts, tz, title, text, source).join(counts, "hour").join(before, "hour", "left")
    made = made.withColumn("prompt", F.when(F.coalesce("before", F.lit("")) != "", F.concat("before", F.lit("\n\n"), "prompt")).otherwise(F.col("prompt"))).drop("before")
    done = complete(made, client).filter("reply is not null")
    p, c = F.ceil(F.length("prompt") / 4).cast("int"), F.ceil(F.length("reply") / 4).cast("int")
    return done.select("hour", parse_summary(F.col("reply")).alias("content"), "articles_count", "sources_count", p.alias("prompt_tokens"), c.alias("completion_tokens"), cost(p, c).alias("cost_usd"))


def last_of_day(summaries: DataFrame, first: str, last: str, most_topics: int = 5) -> DataFrame:
    """(id, summary, topics): the first daily summary within the bounds of a day, with at most ``most_topics`` topics."""
    rows = summaries.filter((F.col("period_type") == "day") & (F.col("period_end") >= F.lit(first).cast("timestamp")) & (F.col("period_end") <= F.lit(last).cast("timestamp")))
    rows = rows.orderBy("period_end", "id").limit(1)
    return rows.select("id", F.coalesce("content.summary", F.lit("Нет данных")).alias("summary"), F.slice(F.coalesce("content.topics", F.array().cast("array<string>")), 1, most_topics).alias("topics"))


def daily_rollup(hourly: DataFrame, start: str = "hour", summary: str = "content.summary", topics: str = "content.topics") -> DataFrame:
    """(day, text, hours): the hours' summaries in order, each with its first three topics."""
    line = F.concat(F.date_format(start, "HH:mm"), F.lit(": "), F.coalesce(F.col(summary), F.lit("")), F.lit(" ("), F.array_join(F.slice(F.coalesce(F.col(topics), F.array().cast("array<string>")), 1, 3), ", "), F.lit(")"))
    per = hourly.groupBy(F.to_date(start).alias("day")).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("at"), line.alias("line")))).alias("lines"))  # 24 hours a day
    return per.select("day", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.size("lines").alias("hours"))


def brief_hours(hours: int | None) -> int:
    """The window of a brief: 1 to 168 hours, 6 where none is asked for."""
    return max(1, min(168, 6 if hours is None else hours))


def brief(summaries: DataFrame, as_of: str, hours: int | None = None, most: int = 12) -> DataFrame:
    """(period_end, line): the last hourly summaries of the window, oldest first by period_end."""
    first = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {brief_hours(hours)} HOURS")
    rows = summaries.filter((F.col("period_type") == "hour") & (F.col("period_end") >= first) & (F.col("period_end") <= F.lit(as_of).cast("timestamp")))
    rows = rows.orderBy(F.desc("period_end"), F.desc("id")).limit(most)
    return rows.select("id", "period_end", F.coalesce("content.summary", F.lit("Нет данных")).alias("line"))


def digest(content: Column) -> Column:
    """The text of a daily digest: summary, at most three topics, the trend if there is one."""
    none = F.array().cast("array<string>")
    topics = F.array_join(F.slice(F.coalesce(content["topics"], none), 1, 3), ", ")
    trend = F.coalesce(content["trend"], F.lit(""))
    text = F.concat(F.coalesce(content["summary"], F.lit("")), F.lit("\n"), topics, F.when(trend != "", F.concat(F.lit("\n"), trend)).otherwise(""))
    return F.when(content.isNull(), F.lit("Нет данных")).otherwise(text)
