"""Landed feeds, sitemaps, archives and posts made of the tables and read back, conversion, ingest; reports and display.

The landed files hold every row of their table, so that what comes out can be compared with the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as t
from tidewire.functions.replies import parse_cleanup
from tidewire.functions.timeutil import display_date, from_zone, to_zone
from tidewire.operators import extract, pipelines, store, summaries
from tidewire.operators.store import TableStore
from tidewire.session import scratch_path, table
from tidewire.sources import landed
from tidewire.sources.registry import Registry, Source, ingest
from tidewire.streaming.ingest import file_stream, hourly_windows

TZ = "Europe/Moscow"
SECTIONS = ["main", "world", "sport"]


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_articles")


def _wall(ts: Column) -> Column:
    """An instant's UTC wall clock."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _xml(value: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _feed(spark: SparkSession, sf_dir: str) -> str:
    """All articles as feed files in three section folders; the first link is empty, as in some feeds."""
    root = scratch_path(spark, "feed")
    item = F.concat(
        F.lit("<item><link> </link><link>"), _xml(F.col("url")), F.lit("</link><link>https://other.example/</link><title>"), _xml(F.col("raw_title")), F.lit("</title><category>"),
        F.coalesce("language", F.lit("ru")), F.lit("</category><description>"), F.col("id").cast("string"), F.lit("</description></item>"),
    )
    section = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), (F.pmod(F.coalesce("source_id", F.lit(0)), F.lit(3)) + 1).cast("int"))
    # A file holds one document of at most 200 items.
    rows = _articles(spark, sf_dir).select(section.alias("section"), F.floor(F.col("id") / 200).alias("chunk"), item.alias("item"))
    files = rows.groupBy("section", "chunk").agg(F.concat(F.lit("<rss><channel>\n"), F.array_join(F.array_sort(F.collect_list("item")), "\n"), F.lit("\n</channel></rss>")).alias("value"))
    files.drop("chunk").write.partitionBy("section").option("maxRecordsPerFile", 1).text(root)
    return root


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.feed_items(spark, f"{_feed(spark, sf_dir)}/*", "full", lambda f: F.regexp_extract(f, r"section=(\w+)", 1))


def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed item with its first link that is none too short."""
    return _items(spark, sf_dir).select("summary", "url", "section", F.md5(F.coalesce("title", F.lit(""))).alias("title_md5"))


def feed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item a url, from the first section that has it."""
    return landed.feed_articles(_items(spark, sf_dir), SECTIONS, min_length=1).select("url", "section")


def feed_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.feed_articles(_items(spark, sf_dir), SECTIONS, category="RU", min_length=1).select("url", "section")


def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by the rule of feeds and by that of archives."""
    p = table(spark, sf_dir, "processed_articles")
    listed = F.when(F.col("topic").isNotNull(), F.array("topic"))
    return p.select("id", landed.category_of_feed(listed, "спорт").alias("feed"), landed.category_of_archive(F.col("topic"), "Спорт").alias("archive"))


def sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles as sitemap entries, some with a date that is none and some of another site; what is read."""
    a = _articles(spark, sf_dir)
    stamp = F.when(F.col("id") % 10 == 0, "31.31.2025").otherwise(F.date_format(_wall(F.col("retrieved_at")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    entry = F.concat(F.lit("<url>\n<loc> "), F.col("url"), F.lit("?id="), F.col("id").cast("string"), F.lit(" </loc>\n<lastmod>"), stamp, F.lit("</lastmod></url>"))
    rows = landed.sitemap_entries(a.select(entry.alias("value")), article_url=r"^https?://\S+[02468]$")
    return rows.select("url", F.unix_seconds("lastmod").alias("at"))


def sitemap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of all sitemaps (one a source), each from those only whose bounds hold it."""
    a = _articles(spark, sf_dir).select("url", _wall(F.col("retrieved_at")).alias("lastmod"), F.coalesce("source_id", F.lit(0)).alias("name"))
    bounds = landed.sitemap_bounds(a)
    days = [landed.sitemap_day(a, bounds, d).withColumn("day", F.lit(d)) for d in ("2025-11-10", "2025-12-24")]
    return days[0].unionByName(days[1]).groupBy("day", "url").agg(F.count("*").alias("cnt"))


def archive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives by day page: the first 20 links of each day, pages in the order of ids."""
    a = _articles(spark, sf_dir)
    page = F.concat(F.lit('<li><a class="card" href="'), F.col("url"), F.lit('">x</a> <a href="'), F.col("url"), F.lit('#c">y</a>'))
    pages = a.select(F.to_date(_wall(F.col("retrieved_at"))).alias("day"), F.col("id").alias("page"), page.alias("value"))
    return landed.page_links(pages, r'class="card" href="([^"#]+)"', most_links=20)


def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives by search pages: paths in order, each once a day."""
    a = _articles(spark, sf_dir)
    pages = a.select(F.to_date(_wall(F.col("retrieved_at"))).alias("day"), F.col("id").alias("page"), F.concat(F.lit("<a href='"), F.col("url"), F.lit("'>")).alias("value"))
    return landed.page_links(pages, r"href='https?://[^/']+(/[^']*)'", most_links=200).groupBy("day").agg(F.count("*").alias("links"), F.min_by("url", "number").alias("first"))


def archive_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged JSON archive, one item a page, that ends at half of its pages: kinds and hosts left out, urls once."""
    a = _articles(spark, sf_dir)
    end = a.agg(F.max("id").alias("end"))  # one row
    item = F.struct(F.when(F.col("id") % 5 == 0, "photogallery").otherwise("article").alias("type"), F.col("url").alias("fronturl"), F.col("raw_title").alias("title"), F.unix_seconds("retrieved_at").alias("publish_date_t"))
    pages = a.join(F.broadcast(end)).select(F.col("id").alias("page"), F.to_json(F.struct(F.array(item).alias("items"), (F.col("id") * 2 < F.col("end")).alias("moreExists"))).alias("value"))
    return landed.archive_pages(pages, "https://s").select("url", F.unix_seconds("published").alias("at"))


def post_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without a page as posts of a JSON API, flattened: author, tickers, images, counts."""
    a = _articles(spark, sf_dir).filter("raw_html is null")
    tickers = F.filter(F.split("raw_text", r"[^$A-Z]+"), lambda x: F.startswith(x, F.lit("$")))
    item = F.struct(
        F.col("id").cast("string").alias("id"), F.col("published_at").alias("inserted"), F.struct(F.col("author").alias("nickname"), F.lit(None).cast("string").alias("name")).alias("owner"),
        F.struct(F.col("raw_text").alias("text"), F.transform(tickers, lambda x: F.struct(F.substring(x, 2, 9).alias("ticker"))).alias("instruments"), F.array(F.struct(F.when(F.col("id") % 2 == 0, F.col("url")).alias("url"), F.lit("x").alias("alt"))).alias("images")).alias("content"),
        F.struct(F.when(F.col("id") % 3 == 0, F.col("id").cast("int")).alias("totalCount")).alias("reactions"),
    )
    posts = landed.post_pages(a.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value")))
    valid = landed.valid_post(F.col("post_id"), F.col("text"), F.col("author"), F.col("tickers"))
    return posts.select(F.col("post_id").cast("long").alias("id"), "author", F.size("tickers").alias("tickers"), F.size("media").alias("images"), "reactions", "comments", valid.alias("valid"))


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to stored articles in both manners: plain cuts, and cuts with marks."""
    a = _articles(spark, sf_dir)
    long = F.repeat(F.coalesce("raw_text", F.lit("")), 6)
    head = F.repeat(F.coalesce("raw_title", F.lit("")), 9)
    both = []
    for marks in (False, True):
        columns = landed.to_article(F.col("source_id"), F.lit("s"), F.col("url"), head, long, F.col("published_at"), F.col("author"), marks=marks)
        rows = a.select("id", *[c.alias(f"_{n}") for n, c in enumerate(columns)]).select("id", F.col("_1").alias("original_id"), F.md5("_3").alias("title_md5"), F.md5("_4").alias("text_md5"), F.col("_11").alias("status"))
        both.append(rows.withColumn("marks", F.lit(marks)))
    return both[0].unionByName(both[1])


def parsed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir).select("id", landed.parsed_item(F.col("url"), F.col("raw_title"), F.col("raw_text"), F.col("published_at")).alias("p"))
    return a.select("id", "p.url", F.col("p.metadata.text_length").cast("long").alias("text_length"))


def _source_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TableStore]:
    def convert(items: DataFrame) -> DataFrame:
        # An item of a bad number cannot be converted.
        number = F.col("summary").try_cast("long")
        return items.withColumn("row", F.when(number.isNotNull() & (number % 7 != 0), F.struct(number.alias("id"), F.col("url").alias("url"), F.coalesce("title", F.lit("")).alias("title"))))

    registry = Registry()
    registry.add("feed", Source(lambda spark, path: _items(spark, path), convert, "length(row.title) >= 3", {"path": sf_dir}))
    kept = TableStore(spark, scratch_path(spark, "stored"))
    first = ingest(spark, registry, "feed", kept, "articles", ["url"], ["id"])
    second = ingest(spark, registry, "feed", kept, "articles", ["url"], ["id"], {"unknown": 1})
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2))), kept


def source_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call from a registered source to the store, twice: what each run read, saved, skipped and could not convert."""
    return _source_run(spark, sf_dir)[0]


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_run(spark, sf_dir)[1].read("articles").select("id", "url")


def pipeline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole backlog from raw articles to links in empty tables, with the names of all sources (a fixed table) as the engine's:
    per article its entities and how often they are named."""
    names = {r[0]: "organization" for r in table(spark, sf_dir, "sources").select("name").collect()}
    empty = lambda schema: spark.createDataFrame([], schema)
    out = pipelines.link_entities(
        _articles(spark, sf_dir), table(spark, sf_dir, "sources"), empty("id bigint, raw_article_id bigint"), empty("id bigint, normalized_name string, type string"),
        empty("processed_article_id bigint, entity_id bigint"), table(spark, sf_dir, "entity_aliases"), names=names,
    )
    named = out["article_entities"].join(out["entities"].select(F.col("id").alias("entity_id"), "normalized_name"), "entity_id")
    articles = out["processed_articles"].select(F.col("id").alias("processed_article_id"), "raw_article_id")
    return named.join(articles, "processed_article_id").select("raw_article_id", "normalized_name", "count")


def pipeline_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed articles that are new beside the stored ones, under ids after theirs."""
    cleaned = extract.clean_articles(_articles(spark, sf_dir))
    return pipelines.processed_articles(table(spark, sf_dir, "processed_articles"), cleaned).select("id", "raw_article_id", F.md5("text").alias("text_md5"))


def alias_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed aliases and type fixes: which rows are added where every entity's name is a stored canonical already."""
    e = table(spark, sf_dir, "entities")
    stored = e.select(F.concat("normalized_name", F.lit("?")).alias("alias_name"), F.col("type").alias("alias_type"), F.col("normalized_name").alias("canonical_name"), F.col("type").alias("canonical_type"))
    proposed = table(spark, sf_dir, "entity_aliases").filter("alias_type is not null")
    fixes = e.filter("type = 'event'").select(F.concat(F.lit("о "), "normalized_name").alias("name"), F.col("type").alias("current_type"), F.lit("concept").alias("correct_type"))
    return pipelines.apply_aliases(stored, proposed, fixes)


def discard_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of entities, links and aliases once all events are discarded."""
    gone = table(spark, sf_dir, "entities").filter("type = 'event'").select(F.col("normalized_name").alias("name"), "type")
    aliases = store.keep_last(table(spark, sf_dir, "entity_aliases").withColumn("seq", F.col("id")), ["alias_name", "alias_type"], "seq")
    left = pipelines.drop_discards(table(spark, sf_dir, "entities"), table(spark, sf_dir, "article_entities"), aliases, gone)
    count = lambda n, df: df.agg(F.lit(n).alias("name"), F.count("*").alias("cnt"))
    return count("entities", left[0]).unionByName(count("links", left[1])).unionByName(count("aliases", left[2])).unionByName(count("marks", left[2].filter("canonical_type = 'discard'")))


def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias table as a JSON report, read back for review."""
    path = scratch_path(spark, "report")
    pipelines.write_report(table(spark, sf_dir, "entity_aliases").select("id", "alias_name", "alias_type", "canonical_name", "canonical_type"), path)
    return pipelines.read_report(spark, path, "id int, alias_name string, alias_type string, canonical_name string, canonical_type string")


def cleanup_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias rows written as clean-up replies (every fifth is no JSON) and read back."""
    a = table(spark, sf_dir, "entity_aliases")
    alias = F.struct("alias_name", "alias_type", "canonical_name", "canonical_type")
    reply = F.when(F.col("id") % 5 == 0, "извините").otherwise(F.to_json(F.struct(F.array(alias).alias("aliases"), F.array(F.struct(F.col("alias_name").alias("name"), F.col("alias_type").alias("type"))).alias("discard"))))
    out = a.select("id", parse_cleanup(reply).alias("r"))
    return out.select("id", F.size(F.coalesce("r.aliases", F.array())).alias("aliases"), F.get("r.aliases", F.lit(0))["canonical_name"].alias("canonical"), F.size(F.coalesce("r.discard", F.array())).alias("discards"))


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading of all processed articles: its mentions are the stored links, articles whose id ends in 9 failed."""
    p = table(spark, sf_dir, "processed_articles").select("id")
    failed = p.filter("id % 10 = 9").select(F.col("id").alias("article_id"), F.lit(None).cast("string").alias("normalized_name"), F.lit(None).cast("string").alias("entity_type"), F.lit("E").alias("error"))
    links = table(spark, sf_dir, "article_entities").select(F.col("processed_article_id").alias("article_id"), F.col("entity_id").cast("string").alias("normalized_name"), F.lit("person").alias("entity_type"), F.lit(None).cast("string").alias("error"))
    return extract.run_statistics(p, links.unionByName(failed))


def _engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").select(F.col("id").alias("entity_id"), "normalized_name", F.col("type").alias("entity_type"))
    links = table(spark, sf_dir, "article_entities").join(e, "entity_id").filter("importance_score is not null and count is not null")
    rows = links.select(F.col("processed_article_id").alias("article_id"), "normalized_name", "entity_type", "importance_score", "count")
    return rows.withColumn("engine", F.explode(F.when(F.col("count") >= 2, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("left"))))).drop("count")


def engine_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines' mentions (all links; links of two mentions or more) by type and importance."""
    return pipelines.engine_profile(_engines(spark, sf_dir))


def engine_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only the first of them finds, by its place in the order of display."""
    m = _engines(spark, sf_dir)
    return pipelines.only_left(m.filter("engine = 'left'"), m.filter("engine = 'right'")).groupBy("rank", "entity_type").agg(F.count("*").alias("cnt"))


def engine_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _engines(spark, sf_dir)
    return pipelines.compare_engines(m.filter("engine = 'left'"), m.filter("engine = 'right'")).select("engine", "total", "articles", "per_article", "common")


def importance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "article_entities").filter("importance_score is not null")
    return e.groupBy(t.importance_label(F.col("importance_score")).alias("label")).agg(F.count("*").alias("cnt"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surroundings of each article's last title word in its text."""
    p = table(spark, sf_dir, "processed_articles").filter("title is not null and text is not null")
    word = F.element_at(F.split("title", " "), -1)
    return p.select("id", t.snippet(F.col("text"), word, 20).alias("snippet"))


def profile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    return a.select("id", t.profile_url("https://p.example/", F.col("author"), F.col("original_id")).alias("profile"), t.author_name(F.col("author"), F.col("language")).alias("shown"))


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in bold in both dialects."""
    a = _articles(spark, sf_dir)
    return a.select("id", t.bold(F.col("raw_title"), 1).alias("first"), t.bold(F.col("raw_title"), 2).alias("second"))


def result_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest articles as the list of an answer, ended by its length."""
    a = landed.newest_first(_articles(spark, sf_dir).filter("raw_title is not null"), "retrieved_at", 200)
    return t.result_list(a, [F.desc_nulls_last("retrieved_at"), F.col("id")], F.col("raw_title"))


def sources_by_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by their last check, those without one last, with the date as shown."""
    s = table(spark, sf_dir, "sources")
    rows = landed.newest_first(s, "last_checked_at", 20)
    wall = to_zone(_wall(F.col("last_checked_at")), TZ)
    return rows.select("id", display_date(wall).alias("shown"), display_date(wall, False).alias("day"))


def zone_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants to a zone's wall clock and back: the same but for the second of two equal hours; null stays null."""
    a = _articles(spark, sf_dir).select("id", _wall(F.col("retrieved_at")).alias("at"))
    back = from_zone(to_zone(F.col("at"), TZ), TZ)
    return a.select("id", F.date_format(to_zone(F.col("at"), TZ), "yyyy-MM-dd HH:mm:ss").alias("local"), (back == F.col("at")).alias("same"))


def replaced_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags document of every article with a text of 1000 letters or more replaced as a whole."""
    p = table(spark, sf_dir, "processed_articles")
    flags = F.struct(F.lit(True).alias("ner"), F.lit(False).alias("sentiment"), F.lit(True).alias("embedding"))
    out = store.replace_values(p, p.filter("length(text) >= 1000").select("id", flags.alias("processing_flags")), "processing_flags")
    return out.groupBy("processing_flags.ner", "processing_flags.sentiment", "processing_flags.embedding").agg(F.count("*").alias("cnt"))


def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with their defaults, and keys that are not unique."""
    a = _articles(spark, sf_dir).select("id", "url", "author", "language")
    return store.with_defaults(a, {"author": F.lit("Аноним"), "language": F.lit("ru"), "kind": F.lit("article")}).groupBy("author", "language", "kind").agg(F.count("*").alias("cnt"))


def not_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.not_unique(_articles(spark, sf_dir), ["url"])


def truncate_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table emptied and filled again: ids start at 1."""
    kept = TableStore(spark, scratch_path(spark, "emptied"))
    kept.write("entities", table(spark, sf_dir, "entities").select("id", "normalized_name", "type"))
    kept.truncate("entities")
    fresh = table(spark, sf_dir, "entities").select(F.col("id").alias("old_id"), "normalized_name", "type")
    return store.assign_ids(kept.read("entities"), fresh, "id", [F.desc("old_id")]).select("id", "old_id")


def backfill_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week day by day, one of whose days fails."""
    a = _articles(spark, sf_dir).select(F.to_date(_wall(F.col("retrieved_at"))).alias("day"))

    def run(day: str) -> int:
        if day == "2025-12-03":
            raise ValueError("no connection")
        return a.filter(F.col("day") == F.lit(day).cast("date")).count()

    return pipelines.backfill(spark, "2025-12-01", "2025-12-07", run)


def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of a year with its articles, those without any too."""
    n = _articles(spark, sf_dir).groupBy(F.to_date(_wall(F.col("retrieved_at"))).alias("day")).agg(F.count("*").alias("cnt"))
    return landed.day_spine(spark, "2025-01-01", "2025-12-31").join(n, "day", "left").select("day", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by status, and the five sources with the most."""
    a = _articles(spark, sf_dir)
    by = a.groupBy(F.concat(F.lit("status:"), F.col("status")).alias("name")).agg(F.count("*").alias("cnt"))
    per = a.groupBy("source_id").agg(F.count("*").alias("cnt")).join(table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), F.concat(F.lit("source:"), F.col("name")).alias("name")), "source_id")
    return by.unionByName(per.orderBy(F.desc("cnt"), "name").limit(5).select("name", "cnt"))


def yesterday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first daily summary of a period, with five topics."""
    s = table(spark, sf_dir, "summarizations")
    return summaries.last_of_day(s, "2025-10-01 00:00:00Z", "2025-12-31 23:59:59Z").select("id", "summary", F.array_join("topics", ";").alias("topics"))


def new_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of events that are not summed up yet, with a stand-in for the model; those of the first half are stored."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "props")
    args = ("ts", TZ, "event_type", "props", "user_id")
    hours = summaries.hourly_counts(e, "ts", "user_id", TZ).select("hour")
    stored = hours.filter("hour < timestamp_ntz'2024-01-16 00:00:00'").withColumn("content", F.struct(F.lit("итог").alias("summary")))
    made = summaries.summarise_new(stored, e, lambda p: '{"summary": "' + ("после" if p.startswith("итог") else "сначала") + '", "topics": ["a"]}', *args)
    return made.select("hour", "content.summary", "articles_count", "sources_count")


def summary_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "summarizations").filter("content is not null")
    doc = F.to_json(summaries.with_meta(F.col("content"), "m", F.size("content.topics")))
    return s.select("id", F.get_json_object(doc, "$._meta.model").alias("model"), F.get_json_object(doc, "$._meta.posts").cast("int").alias("posts"))


def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each hour of events (its hash and its lines): the newest 40 by time and id."""
    e = table(spark, sf_dir, "events").select("ts", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("title"), "event_type", "user_id")
    p = summaries.prompts(e, "ts", TZ, "title", "event_type", "user_id")
    return p.select("hour", F.md5("prompt").alias("prompt_md5"))


def feed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed HTML made of all documents, to lines."""
    d = table(spark, sf_dir, "documents")
    page = F.concat(F.lit("<p class='a'>"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("<BR />")), F.lit("</p>\n \n<p><b>конец</b></p>"))
    return d.select("doc_id", F.md5(F.regexp_replace(t.feed_text(page), r"(?U)\s+", " ")).alias("text_md5"))


def lists_and_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    fenced = F.concat(F.lit("```json\n"), F.coalesce("raw_title", F.lit("")), F.lit("\n```"))
    return a.select("id", t.strip_code_fence(fenced).alias("inner"), F.size(t.split_list(F.replace(F.coalesce("raw_title", F.lit("")), F.lit(" "), F.lit(" ,")))).alias("parts"))


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days over the hours that a first stream has closed: a second stream over the first one's sink."""
    root = scratch_path(spark, "days")
    events = table(spark, sf_dir, "events").select("ts")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{root}/landed")
    hours = hourly_windows(file_stream(spark, f"{root}/landed", events, "*.parquet", 4), "ts")
    sink = lambda name: {"path": f"{root}/{name}", "checkpointLocation": f"{root}/{name}-checkpoint"}
    hours.writeStream.outputMode("append").format("parquet").options(**sink("hours")).trigger(availableNow=True).start().awaitTermination()
    closed = spark.readStream.schema("hour timestamp, cnt bigint").parquet(f"{root}/hours").withWatermark("hour", "1 hour")
    days = closed.groupBy(F.window("hour", "1 day")).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("hours"))
    days.select(F.col("window.start").alias("day"), "cnt", "hours").writeStream.outputMode("append").format("parquet").options(**sink("out")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day timestamp, cnt bigint, hours bigint").parquet(f"{root}/out").select(F.unix_micros("day").alias("day_us"), "cnt", "hours")


QUERIES = {f.__name__: f for f in (feed_scan, feed_sections, feed_category, category_rules, sitemap_scan, sitemap_days, archive_days, archive_search, archive_api, post_feed, converted, parsed_items, source_to_store, stored_articles, pipeline_links, pipeline_articles, alias_apply, discard_marks, report_round_trip, cleanup_replies, run_statistics, engine_profile, engine_difference, engine_comparison, importance_labels, snippets, profile_urls, marked_up, result_list, sources_by_check, zone_round_trip, replaced_flags, defaults, not_unique, truncate_restart, backfill_days, day_counts, overall_stats, yesterday, new_summaries, summary_meta, prompt_lines, feed_texts, lists_and_fences, stream_daily)}

_SECTION = "case coalesce(source_id, 0) % 3 when 0 then 'main' when 1 then 'world' else 'sport' end"
_RANK = f"case {_SECTION} when 'main' then 1 when 'world' then 2 else 3 end"
_UTC = "make_timestamp(epoch_us(retrieved_at))"
_LABEL = "case when importance_score >= 0.9 then 'subject' when importance_score >= 0.5 then 'key' else 'mention' end"
_MENTIONS = """
l as (select a.processed_article_id as article_id, e.normalized_name, e.type as entity_type, a.importance_score, a.count from article_entities a join entities e on e.id = a.entity_id
      where a.importance_score is not null and a.count is not null),
m as (select *, 'left' as engine from l union all select *, 'right' from l where count >= 2)"""
_SQUEEZED = r"trim(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}\x{{85}}\x{{0B}}\x{{1c}}-\x{{1f}}]+', ' ', 'g'))"
_GOOD = "id % 7 <> 0 and length(trim(coalesce(raw_title, ''), ' ')) >= 3"
SQL = {
    "feed_scan": f"select cast(id as varchar) as summary, url, {_SECTION} as section, md5(trim(coalesce(raw_title, ''), ' ')) as title_md5 from raw_articles",
    "feed_sections": f"select url, min_by({_SECTION}, {_RANK}) as section from raw_articles group by 1",
    "feed_category": f"select url, min_by({_SECTION}, {_RANK}) as section from raw_articles where contains(lower(coalesce(language, 'ru')), 'ru') group by 1",
    "category_rules": "select id, topic is null or contains(lower(topic), 'спорт') as feed, coalesce(topic = 'Спорт', false) as archive from processed_articles",
    "sitemap_scan": "select url || '?id=' || id as url, cast(floor(epoch_us(retrieved_at) / 1000000) as bigint) as at from raw_articles where id % 10 <> 0 and id % 2 = 0",
    "sitemap_days": f"select cast(cast({_UTC} as date) as varchar) as day, url, count(*) as cnt from raw_articles where cast({_UTC} as date) in (date '2025-11-10', date '2025-12-24') group by 1, 2",
    "archive_days": f"""
with f as (select cast({_UTC} as date) as day, url, min(id) as id from raw_articles group by 1, 2)
select day, url, cast(n as integer) as number from (select *, row_number() over (partition by day order by id) as n from f) where n <= 20""",
    "archive_search": f"""
with f as (select cast({_UTC} as date) as day, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) as path, min(id) as id from raw_articles group by 1, 2)
select day, count(*) as links, min_by(path, id) as first from (select *, row_number() over (partition by day order by id) as n from f) where n <= 200 group by 1""",
    "archive_api": """
select url, cast(floor(epoch_us(min_by(retrieved_at, id)) / 1000000) as bigint) as at from raw_articles
where id <= (select min(id) from raw_articles where id * 2 >= (select max(id) from raw_articles)) and id % 5 <> 0 and starts_with(url, 'https://s') group by 1""",
    "post_feed": r"""
with a as (select *, list_filter(regexp_split_to_array(raw_text, '[^$A-Z]+'), lambda x: starts_with(x, '$') and length(x) > 1) as tickers from raw_articles where raw_html is null),
b as (select *, case when coalesce(author, '') = '' then 'Аноним' else author end as shown from a)
select id, shown as author, cast(coalesce(len(tickers), 0) as integer) as tickers, cast(case when id % 2 = 0 then 1 else 0 end as integer) as images,
  cast(case when id % 3 = 0 then id else 0 end as integer) as reactions, cast(0 as integer) as comments, coalesce(length(raw_text) >= 10 and len(tickers) > 0, false) as valid from b""",
    "converted": """
with a as (select id, url, repeat(coalesce(raw_text, ''), 6) as x, case when trim(repeat(coalesce(raw_title, ''), 9), ' ') = '' then 'Без заголовка' else trim(repeat(coalesce(raw_title, ''), 9), ' ') end as t from raw_articles)
select id, 's_' || substr(md5(url), 1, 12) as original_id, md5(substr(t, 1, 500)) as title_md5, md5(substr(x, 1, 10000)) as text_md5, 'raw' as status, false as marks from a
union all select id, 's_' || substr(md5(url), 1, 12), md5(case when length(t) > 500 then substr(t, 1, 500) || '...' else t end),
  md5(case when length(x) > 10000 then substr(x, 1, 10000) || '... [TRUNCATED]' else x end), 'raw', true from a""",
    "parsed_items": "select id, url, length(raw_text) as text_length from raw_articles",
    "source_to_store": f"""
with g as (select count(*) as total, count(*) filter (not ({_GOOD})) as errors, count(distinct url) filter ({_GOOD}) as saved from raw_articles)
select total as total_rows, saved, total - saved - errors as skipped, errors, 1 as run from g union all select total, 0, total - errors, errors, 2 from g""",
    "stored_articles": f"select min(id) as id, url from raw_articles where {_GOOD} group by url",
    "pipeline_links": rf"""
with a as (select id, {_SQUEEZED.format("raw_title")} as t, {_SQUEEZED.format("raw_text")} as x from raw_articles),
w as (select id, case when t <> '' then t || chr(10) || x else x end as whole from a)
select w.id as raw_article_id, upper(substr(translate(n.name, 'ёЁ', 'еЕ'), 1, 1)) || substr(translate(n.name, 'ёЁ', 'еЕ'), 2) as normalized_name,
  cast((length(whole) - length(replace(whole, n.name, ''))) // length(n.name) as bigint) as count
from w join (select distinct name from sources where name is not null) n on contains(w.whole, n.name)""",
    "pipeline_articles": rf"""
select (select max(id) from processed_articles) + row_number() over (order by id) as id, id as raw_article_id, md5({_SQUEEZED.format("raw_text")}) as text_md5
from raw_articles where id not in (select raw_article_id from processed_articles)""",
    "alias_apply": """
with u as (
  select alias_name, alias_type, canonical_name, canonical_type, 0 as prio from entity_aliases where alias_type is not null
  union all select 'о ' || normalized_name, type, 'о ' || normalized_name, 'concept', 1 from entities where type = 'event'),
r as (select *, row_number() over (partition by alias_name, alias_type order by prio, canonical_name nulls first) as n from u)
select alias_name, alias_type, canonical_name, canonical_type from r where n = 1
and not exists (select 1 from entities e where lower(e.normalized_name) = lower(r.alias_name) and e.type = r.alias_type)
and not exists (select 1 from entities e where e.normalized_name || '?' = r.alias_name and e.type = r.alias_type)""",
    "discard_marks": """
with gone as (select distinct normalized_name as name, type from entities where type = 'event'), a as (select distinct alias_name, alias_type from entity_aliases),
d as (select alias_name, alias_type, arg_max(canonical_type, id) as hi from entity_aliases group by 1, 2)
select 'entities' as name, count(*) as cnt from entities where type <> 'event'
union all select 'links', count(*) from article_entities where entity_id not in (select id from entities where type = 'event')
union all select 'aliases', (select count(*) from a) + (select count(*) from gone where not exists (select 1 from a where a.alias_name = gone.name and a.alias_type = gone.type))
union all select 'marks', (select count(*) from gone) + (select count(*) from d where hi = 'discard' and not exists (select 1 from gone where gone.name = d.alias_name and gone.type = d.alias_type))""",
    "report_round_trip": "select id, alias_name, alias_type, canonical_name, canonical_type from entity_aliases",
    "cleanup_replies": """
select id, cast(case when id % 5 = 0 then 0 else 1 end as integer) as aliases, case when id % 5 <> 0 then canonical_name end as canonical, cast(case when id % 5 = 0 then 0 else 1 end as integer) as discards from entity_aliases""",
    "run_statistics": """
select (select count(*) from processed_articles) as total_articles, (select count(*) from processed_articles where id % 10 <> 9) as processed,
  (select count(*) from processed_articles where id % 10 = 9) as failed, (select count(*) from (select distinct processed_article_id, entity_id from article_entities)) as total_entities""",
    "engine_profile": f"with {_MENTIONS} select engine, entity_type as type, {_LABEL} as importance, count(*) as cnt from m group by 1, 2, 3",
    "engine_difference": f"""
with {_MENTIONS} select cast(case {_LABEL} when 'subject' then 1 when 'key' then 2 else 3 end as integer) as rank, entity_type, count(*) as cnt from l
where not exists (select 1 from l r where r.count >= 2 and r.article_id = l.article_id and r.normalized_name = l.normalized_name and r.entity_type = l.entity_type) group by 1, 2""",
    "engine_comparison": f"""
with {_MENTIONS}, d as (select distinct engine, article_id, normalized_name, entity_type from m)
select engine, count(*) as total, count(distinct article_id) as articles, round(count(*) / count(distinct article_id), 3) as per_article,
  (select count(*) from (select article_id, normalized_name, entity_type from d where engine = 'left' intersect select article_id, normalized_name, entity_type from d where engine = 'right')) as common
from d group by 1""",
    "importance_labels": f"select {_LABEL} as label, count(*) as cnt from article_entities where importance_score is not null group by 1",
    "snippets": """
with w as (select id, text, list_extract(string_split(title, ' '), -1) as w from processed_articles where title is not null and text is not null),
a as (select *, strpos(lower(text), lower(w)) as p from w)
select id, case when p > 0 then trim(substr(text, greatest(1, p - 20), p + length(w) + 20 - greatest(1, p - 20)), ' ') end as snippet from a""",
    "profile_urls": """
select id, case when coalesce(author, '') <> '' and coalesce(original_id, '') <> '' then 'https://p.example/' || author || '/' || original_id else '' end as profile,
  coalesce(nullif(author, ''), nullif(language, ''), 'Аноним') as shown from raw_articles""",
    "marked_up": r"""
select id, '*' || regexp_replace(coalesce(raw_title, ''), '([_*`\[])', '\\\1', 'g') || '*' as first,
  '*' || regexp_replace(coalesce(raw_title, ''), '([_*\[\]()~`>#+\-=|{}.!\\])', '\\\1', 'g') || '*' as second from raw_articles""",
    "result_list": """
with r as (select *, row_number() over (order by retrieved_at desc nulls last, id) as n from raw_articles where raw_title is not null order by n limit 200),
l as (select n, n || '. ' || replace(replace(replace(substr(raw_title, 1, 70), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as line from r),
s as (select *, sum(length(line) + 1) over (order by n) as total from l)
select cast(n as integer) as number, line from s where total <= 3500""",
    "sources_by_check": """
select id, coalesce(strftime(timezone('Europe/Moscow', last_checked_at), '%d.%m.%Y %H:%M'), 'Дата неизвестна') as shown, coalesce(strftime(timezone('Europe/Moscow', last_checked_at), '%d.%m.%Y'), 'Дата неизвестна') as day
from (select * from sources order by last_checked_at desc nulls last, id limit 20)""",
    "zone_round_trip": "select id, strftime(timezone('Europe/Moscow', retrieved_at), '%Y-%m-%d %H:%M:%S') as local, timezone('Europe/Moscow', retrieved_at) <> timezone('Europe/Moscow', retrieved_at - interval 1 hour) as same from raw_articles",
    "replaced_flags": """
select case when length(text) >= 1000 then true else processing_flags.ner end as ner, case when length(text) >= 1000 then false else processing_flags.sentiment end as sentiment,
  case when length(text) >= 1000 then true else processing_flags.embedding end as embedding, count(*) as cnt from processed_articles group by 1, 2, 3""",
    "defaults": "select coalesce(author, 'Аноним') as author, coalesce(language, 'ru') as language, 'article' as kind, count(*) as cnt from raw_articles group by 1, 2, 3",
    "not_unique": "select url, count(*) as cnt from raw_articles where url is not null group by 1 having count(*) > 1",
    "truncate_restart": "select row_number() over (order by id desc) as id, id as old_id from entities",
    "backfill_days": f"""
select cast(cast(d as date) as varchar) as day, case when cast(d as date) <> date '2025-12-03' then (select count(*) from raw_articles where cast({_UTC} as date) = cast(d as date)) end as rows,
  case when cast(d as date) = date '2025-12-03' then 'ValueError: no connection' end as error
from (select unnest(generate_series(timestamp '2025-12-01', timestamp '2025-12-07', interval 1 day)) as d)""",
    "day_counts": f"""
select cast(d as date) as day, coalesce(cnt, 0) as cnt from (select unnest(generate_series(timestamp '2025-01-01', timestamp '2025-12-31', interval 1 day)) as d)
left join (select cast({_UTC} as date) as day, count(*) as cnt from raw_articles group by 1) n on n.day = cast(d as date)""",
    "overall_stats": """
select 'status:' || status as name, count(*) as cnt from raw_articles group by 1
union all select * from (select 'source:' || s.name as name, count(*) as cnt from raw_articles r join sources s on s.id = r.source_id group by s.id, s.name order by 2 desc, 1 limit 5)""",
    "yesterday": """
select id, coalesce(content.summary, 'Нет данных') as summary, array_to_string(list_slice(coalesce(content.topics, []), 1, 5), ';') as topics from summarizations
where period_type = 'day' and epoch_us(period_end) between epoch_us(timestamp '2025-10-01') and epoch_us(timestamp '2025-12-31 23:59:59') order by period_end, id limit 1""",
    "new_summaries": """
with h as (select date_trunc('hour', ts + interval 3 hour) as hour, count(*) as articles_count, count(distinct user_id) as sources_count from events group by 1 having count(*) >= 3)
select hour, case when hour = timestamp '2024-01-16' and exists (select 1 from h p where p.hour = timestamp '2024-01-15 23:00:00') then 'после' else 'сначала' end as summary, articles_count, sources_count
from h where hour >= timestamp '2024-01-16'""",
    "summary_meta": "select id, 'm' as model, cast(coalesce(len(content.topics), -1) as integer) as posts from summarizations where content is not null",
    "prompt_lines": """
with r as (select *, lpad(cast(event_id as varchar), 12, '0') as title, date_trunc('hour', ts + interval 3 hour) as hour from events),
n as (select *, row_number() over (partition by hour order by ts desc, title) as n from r)
select hour, md5(string_agg('[' || strftime(ts, '%H:%M') || '] [' || coalesce(cast(user_id as varchar), '') || '] ' || title || chr(10) || substr(coalesce(event_type, ''), 1, 300) || '...', chr(10) || chr(10) order by n)) as prompt_md5
from n where n <= 40 group by 1""",
    "feed_texts": r"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g') || ' конец', '[\s\p{Z}\x{85}]+', ' ', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as text_md5 from documents""",
    "lists_and_fences": r"""
select id, trim(coalesce(raw_title, ''), ' ') as inner, cast(len(list_filter(string_split(replace(coalesce(raw_title, ''), ' ', ' ,'), ','), lambda x: trim(x) <> '')) as integer) as parts from raw_articles""",
    "stream_daily": """
with h as (select date_trunc('hour', ts) as hour, count(*) as cnt from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 5 minute from events) group by 1)
select epoch_us(date_trunc('day', hour)) as day_us, cast(sum(cnt) as bigint) as cnt, count(*) as hours from h where date_trunc('day', hour) + interval 1 day <= (select max(hour) - interval 1 hour from h) group by 1""",
}
