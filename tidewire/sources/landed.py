"""Landed files as tables: feeds (XML), sitemaps, JSON pages, HTML pages; and their conversion to stored articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import NO_TITLE, article_id, author_name, cut, cut_with_mark, post_id, post_title
from tidewire.functions.timeparse import with_instant, with_parts
from tidewire.operators.store import keep_first

FEED = "link array<string>, title string, description string, pubDate string, category array<string>, author string, full_text string"
POSTS = (
    "struct<items:array<struct<id:string,inserted:string,owner:struct<nickname:string,name:string>,content:struct<text:string,"
    "instruments:array<struct<ticker:string>>,images:array<struct<url:string,alt:string>>>,reactions:struct<totalCount:int>,commentsCount:int>>,"
    "nextCursor:string,hasNext:boolean>"
)
ARCHIVE = "struct<items:array<struct<type:string,fronturl:string,title:string,publish_date_t:bigint>>,moreExists:boolean>"
#: Kinds of archive items that are no articles.
SKIP_TYPES = ("uploaded_video", "special_project", "photogallery", "photoreport")


def feed_items(spark: SparkSession, path: str, full_text_tag: str = "full_text", section_of=None) -> DataFrame:
    """One row per feed item: url (the first link), title, summary, full_text, published, categories, section, position."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(FEED.replace("full_text", f"`{full_text_tag}`")).load(path)
    at = F.col("_metadata.file_path")
    rows = raw.select("*", at.alias("file"), F.monotonically_increasing_id().alias("position"))
    section = section_of(F.col("file")) if section_of else F.lit("main")
    return rows.select(
        F.element_at(F.filter(F.transform("link", lambda x: F.trim(x)), lambda x: x != ""), 1).alias("url"),
        F.trim("title").alias("title"),
        F.col("description").alias("summary"),
        F.col(full_text_tag).alias("full_text"),
        F.col("pubDate").alias("published"),
        F.col("category").alias("categories"),
        "author",
        section.alias("section"),
        "position",
    )


def feed_articles(items: DataFrame, sections: list[str] | None = None, skip: tuple[str, ...] = ("/textonlines/",), category: str | None = None, min_length: int = 100) -> DataFrame:
    """Valid items, the first of each url in section and item order, with the first long enough text of full text and summary."""
    rows = items.filter(F.col("url").isNotNull())
    for part in skip:
        rows = rows.filter(~F.contains("url", F.lit(part)))
    if category is not None:
        rows = rows.filter(category_of_feed(F.col("categories"), category))
    order = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section")) if sections else F.lit(0)
    rows = keep_first(rows, ["url"], [order, F.col("position")])
    content = F.when(F.length("full_text") >= min_length, F.col("full_text")).when(F.length("summary") >= min_length, F.col("summary"))
    return rows.withColumn("content", content).filter("content is not null")


def sitemap_entries(texts: DataFrame, value: str = "value", article_url: str = r"^https?://") -> DataFrame:
    """(url, lastmod): entries of sitemap documents; other urls and unreadable dates are left out. One UDF-free scan."""
    entry = F.explode(F.regexp_extract_all(F.col(value), F.lit(r"(?s)(<loc>.*?</lastmod>)"), 1)).alias("e")
    rows = texts.select(entry)
    rows = rows.select(F.trim(F.regexp_extract("e", r"(?s)<loc>\s*(.*?)\s*</loc>", 1)).alias("url"), F.regexp_extract("e", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1).alias("stated"))
    rows = with_parts(rows.filter(F.col("url").rlike(article_url)).withColumn("_tz", F.lit("UTC")).withColumn("_now", F.lit(None).cast("timestamp")), "stated")
    rows = with_instant(rows, "_tz", "_now", "us")
    return rows.filter("us is not null").select("url", F.timestamp_micros("us").alias("lastmod"))


def sitemap_bounds(entries: DataFrame, name: str = "name") -> DataFrame:
    """(name, low, high): the first and last day of each sitemap's entries; small, and kept between scans of a period."""
    return entries.groupBy(name).agg(F.min("lastmod").alias("low"), F.max("lastmod").alias("high"))


def sitemap_day(entries: DataFrame, bounds: DataFrame, day: str, name: str = "name") -> DataFrame:
    """(url, lastmod) of the day, from those sitemaps only that can hold it."""
    rows = entries.join(F.broadcast(prune_sitemaps(bounds, day).select(name)), name, "left_semi")  # a row a sitemap
    return rows.filter(F.to_date("lastmod") == F.lit(day).cast("date")).select("url", "lastmod")


def page_links(pages: DataFrame, pattern: str, day: str = "day", page: str = "page", value: str = "value", most_pages: int | None = None, most_links: int | None = None) -> DataFrame:
    """(day, url, number): the links of archive or search pages, the first of each url of a day, in the order of pages and
    places. Pages after the ``most_pages``-th and links after the ``most_links``-th of a day are left out where these are given:
    the limits are those of a site's archive."""
    rows = pages if most_pages is None else pages.filter(F.col(page) <= most_pages)
    links = rows.select(F.col(day).alias("day"), F.col(page).alias("page"), F.posexplode(F.regexp_extract_all(F.col(value), F.lit(pattern), F.lit(1))).alias("pos", "url"))
    first = links.groupBy("day", "url").agg(F.min(F.struct("page", "pos")).alias("at"))
    first = first.withColumn("number", F.row_number().over(Window.partitionBy("day").orderBy("at")))
    return (first if most_links is None else first.filter(F.col("number") <= most_links)).select("day", "url", "number")


def category_of_feed(categories: Column, wanted: str) -> Column:
    """Feeds: a category holds the wanted word, ignoring case; items without category pass."""
    none = F.size(F.coalesce(categories, F.array().cast("array<string>"))) == 0
    return none | F.coalesce(F.exists(categories, lambda c: F.contains(F.lower(c), F.lit(wanted.lower()))), F.lit(False))


def category_of_archive(category: Column, wanted: str) -> Column:
    """Archives: the category is the wanted one; none fails."""
    return F.coalesce(category == wanted, F.lit(False))


def valid_post(url: Column, content: Column, author: Column, tickers: Column, min_content: int = 10) -> Column:
    ok = (F.coalesce(url, F.lit("")) != "") & (F.length(content) >= min_content) & (F.coalesce(author, F.lit("")) != "") & (F.size(tickers) > 0)
    return F.coalesce(ok, F.lit(False))


def newest_first(rows: DataFrame, at: str, most: int, tie: str = "id") -> DataFrame:
    """The ``most`` newest rows; those without a date come last."""
    return rows.orderBy(F.desc_nulls_last(at), F.col(tie)).limit(most)


def parsed_item(url: Column, title: Column, content: Column, published: Column) -> Column:
    """An item as a source hands it over, with its length."""
    return F.struct(url.alias("url"), title.alias("title"), content.alias("content"), published.alias("published_at"), F.struct(F.length(content).alias("text_length")).alias("metadata"))


def prune_sitemaps(bounds: DataFrame, day: str) -> DataFrame:
    """The sitemaps (name, low, high) that can hold the day: min/max pruning before any is read."""
    d = F.lit(day).cast("date")
    return bounds.filter((F.to_date("low") <= d) & (F.to_date("high") >= d))


def post_pages(pages: DataFrame, value: str = "value") -> DataFrame:
    """Posts of JSON pages, flattened: tickers are the non-empty ones, counts default to 0."""
    rows = pages.select(F.explode(F.from_json(F.col(value), POSTS)["items"]).alias("p"))
    author = author_name(F.col("p.owner.nickname"), F.col("p.owner.name"))
    tickers = F.filter(F.transform(F.coalesce("p.content.instruments", F.from_json(F.lit("[]"), "array<struct<ticker:string>>")), lambda x: x["ticker"]), lambda t: F.coalesce(t, F.lit("")) != "")
    images = F.filter(F.coalesce("p.content.images", F.from_json(F.lit("[]"), "array<struct<url:string,alt:string>>")), lambda x: F.coalesce(x["url"], F.lit("")) != "")
    rows = rows.select(
        F.col("p.id").alias("post_id"), F.col("p.inserted").alias("inserted"), author.alias("author"), F.col("p.content.text").alias("text"), tickers.alias("tickers"),
        F.transform(images, lambda x: F.struct(x["url"].alias("url"), F.lit("image").alias("type"), x["alt"].alias("alt"))).alias("media"),
        F.coalesce("p.reactions.totalCount", F.lit(0)).alias("reactions"), F.coalesce("p.commentsCount", F.lit(0)).alias("comments"),
    )
    return rows.withColumn("original_id", post_id("post", F.col("post_id"), F.col("inserted"), F.col("text"))).withColumn("title", post_title(F.col("text"), F.col("author"), F.col("tickers")))


def filter_posts(posts: DataFrame, min_reactions: int | None = None, has_images: bool | None = None, author: str | None = None) -> DataFrame:
    if min_reactions is not None:
        posts = posts.filter(F.col("reactions") >= min_reactions)
    if has_images is not None:
        posts = posts.filter((F.size("media") > 0) == has_images)
    return posts.filter(F.col("author") == author) if author is not None else posts


def archive_pages(pages: DataFrame, prefix: str, value: str = "value", page: str = "page") -> DataFrame:
    """(url, title, published): items of archive pages up to the first page that ends the list; other kinds and hosts left out."""
    rows = pages.select(F.col(page).alias("page"), F.from_json(F.col(value), ARCHIVE).alias("d"))
    ends = rows.filter(~F.coalesce("d.moreExists", F.lit(False))).agg(F.min("page").alias("last"))  # one row
    items = rows.join(F.broadcast(ends)).filter("last is null or page <= last").select("page", F.posexplode("d.items").alias("pos", "i"))
    items = items.filter(~F.coalesce(F.col("i.type"), F.lit("")).isin(*SKIP_TYPES) & F.startswith("i.fronturl", F.lit(prefix)))
    items = keep_first(items.select(F.col("i.fronturl").alias("url"), F.col("i.title").alias("title"), F.timestamp_seconds("i.publish_date_t").alias("published"), "page", "pos"), ["url"], [F.col("page"), F.col("pos")])
    return items.select("url", "title", "published")


def day_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day): every day of the inclusive period; the unit of archive scans."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def valid_item(url: Column, title: Column, content: Column, min_content: int = 50) -> Column:
    ok = url.rlike(r"^https?://") & (F.length(F.trim(title)) >= 3) & (F.length(content) >= min_content)
    return F.coalesce(ok, F.lit(False))


def to_article(source_id: Column, source: Column, url: Column, title: Column, content: Column, published: Column, author: Column | None = None, raw_html: Column | None = None, meta: Column | None = None, media: Column | None = None, marks: bool = False) -> list[Column]:
    """The columns of a stored article, cut to the store's limits; ``marks`` adds the marks of a cut first, as some sources do."""
    title = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit(NO_TITLE))
    content = F.coalesce(content, F.lit(""))
    if marks:
        title, content = cut_with_mark(title, 500), cut_with_mark(content, 10000, "... [TRUNCATED]")
    text = lambda c: c if c is not None else F.lit(None).cast("string")
    return [
        source_id.cast("int").alias("source_id"), article_id(source, url).alias("original_id"), url.alias("url"), cut(title, 503 if marks else 500).alias("raw_title"),
        content.alias("raw_text") if marks else cut(content, 10000).alias("raw_text"), cut(text(raw_html), 50000).alias("raw_html"), published.alias("published_at"),
        cut(text(author), 255).alias("author"), F.lit("ru").alias("language"), text(meta).alias("meta_info"), text(media).alias("media_content"), F.lit("raw").alias("status"),
    ]
