"""Landed feeds, sitemaps and pages, and the paged data source."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators.store import TableStore
from tidewire.sources import landed
from tidewire.sources.paged import NotThere, PagedSource, TooMany, fetch
from tidewire.sources.registry import Registry, Source, ingest

FEED = """<rss><channel>
<item><link>https://x.example/1</link><link>https://x.example/alt</link><title> Один </title><description>{d}</description><category>Спорт</category></item>
<item><link>https://x.example/1</link><title>Снова</title><description>{d}</description></item>
<item><link>https://x.example/textonlines/9</link><title>Онлайн</title><description>{d}</description></item>
<item><link>https://x.example/2</link><title>Два</title><description>мало</description><full_text>{d}{d}</full_text><category>Наука</category></item>
<item><link>https://x.example/3</link><title>Три</title><description>мало</description></item>
</channel></rss>""".format(d="слово " * 20)


def test_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FEED, encoding="utf-8")
    items = landed.feed_items(spark, str(tmp_path / "a.xml"))
    got = {r["url"]: r["title"] for r in landed.feed_articles(items).collect()}
    assert got == {"https://x.example/1": "Один", "https://x.example/2": "Два"}
    # An item without categories passes a category filter.
    got = {r["url"]: r["title"] for r in landed.feed_articles(items, category="наук").collect()}
    assert got == {"https://x.example/1": "Снова", "https://x.example/2": "Два"}


def test_sitemap(spark):
    text = "<urlset><url><loc>https://x.example/a/1</loc><lastmod>2026-05-01T10:00:00+03:00</lastmod></url><url><loc>ftp://no</loc><lastmod>2026-05-01</lastmod></url><url><loc>https://x.example/a/2</loc><lastmod>bad</lastmod></url></urlset>"
    rows = landed.sitemap_entries(spark.createDataFrame([(text,)], "value string")).select("url", F.unix_seconds("lastmod").alias("s")).collect()
    assert [(r["url"], r["s"]) for r in rows] == [("https://x.example/a/1", 1777618800)]
    bounds = spark.createDataFrame([("new", "2026-05-01", "2026-05-09"), ("old", "2026-04-01", "2026-04-30")], "name string, low string, high string")
    assert [r["name"] for r in landed.prune_sitemaps(bounds, "2026-05-03").collect()] == ["new"]


def test_posts_and_archive(spark):
    page = {"items": [{"id": "1", "inserted": "2025-02-03T04:05:06.789Z", "owner": {"nickname": "", "name": "Имя"}, "content": {"text": "Сегодня на реке начался ледоход. Смотрите", "instruments": [{"ticker": "LES"}, {"ticker": ""}], "images": [{"url": "u"}, {}]}, "reactions": {"totalCount": 5}}, {"id": "2", "content": {"text": "x"}}], "hasNext": False}
    posts = landed.post_pages(spark.createDataFrame([(json.dumps(page),)], "value string"))
    rows = {r["post_id"]: r for r in posts.collect()}
    assert rows["1"]["title"] == "Имя: Сегодня на реке начался ледоход. Смотрите [LES]" and len(rows["1"]["media"]) == 1
    assert rows["2"]["author"] == "Аноним" and rows["2"]["tickers"] == []
    assert landed.filter_posts(posts, min_reactions=1, has_images=True, author="Имя").count() == 1
    pages = [(1, json.dumps({"items": [{"type": "article", "fronturl": "https://a/1", "title": "t", "publish_date_t": 0}, {"type": "photogallery", "fronturl": "https://a/2"}, {"type": "x", "fronturl": "http://b/3"}], "moreExists": True})), (2, json.dumps({"items": [{"type": "x", "fronturl": "https://a/1"}], "moreExists": False})), (3, json.dumps({"items": [{"type": "x", "fronturl": "https://a/9"}], "moreExists": False}))]
    got = landed.archive_pages(spark.createDataFrame(pages, "page int, value string"), "https://a/").collect()
    assert [r["url"] for r in got] == ["https://a/1"]
    assert landed.day_spine(spark, "2026-01-30", "2026-02-02").count() == 4


def test_conversion(spark):
    row = spark.createDataFrame([("https://x", "т" * 600, "с" * 12000)], "url string, title string, content string")
    cols = landed.to_article(F.lit(1), F.lit("src"), F.col("url"), F.col("title"), F.col("content"), F.lit(None).cast("timestamp"))
    got = row.select(*cols).first()
    assert len(got["raw_title"]) == 500 and len(got["raw_text"]) == 10000 and got["status"] == "raw" and got["language"] == "ru"
    marked = row.select(*landed.to_article(F.lit(1), F.lit("src"), F.col("url"), F.col("title"), F.col("content"), F.lit(None).cast("timestamp"), marks=True)).first()
    assert marked["raw_title"].endswith("...") and marked["raw_text"].endswith("[TRUNCATED]")
    assert row.select(landed.valid_item(F.col("url"), F.lit("ab"), F.col("content"))).first()[0] is False


def pages(topic, cursor):
    """A stand-in for an API: three pages of two posts from new to old."""
    k = int(cursor or 0)
    items = [{"id": f"{topic}{k}{j}", "inserted": f"2026-01-0{6 - 2 * k - j}"} for j in range(2)]
    return items, str(k + 1), k < 2


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    read = lambda **o: spark.read.format("tidewire_paged").options(topics="A,B", client="tests.test_sources:pages", **o).load()
    assert read().count() == 12
    assert read(limit="3").count() == 6
    assert read(since="2026-01-04").count() == 6


def test_fetch_tries_again():
    calls = []

    def flaky(topic, cursor):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [], None, False

    assert fetch(flaky, "a", None) == ([], None, False) and len(calls) == 3


def test_fetch_of_missing_and_refused_pages():
    calls = []

    def gone(topic, cursor):
        calls.append(1)
        raise NotThere(topic)

    with pytest.raises(NotThere):
        fetch(gone, "a", None)
    assert len(calls) == 1  # no second try

    def busy(topic, cursor):
        calls.append(1)
        if len(calls) < 3:
            raise TooMany
        return [1], None, False

    assert fetch(busy, "a", None, pause=0.0) == ([1], None, False)


def test_a_scan_goes_on_where_it_ended(spark):
    spark.dataSource.register(PagedSource)
    read = lambda **o: spark.read.format("tidewire_paged").options(topics="A,B", client="tests.test_sources:pages", **o).load()
    first = read(pages="2").collect()
    resume = {r["topic"]: r["cursor"] for r in first if r["value"] is None}
    assert resume == {"A": "2", "B": "2"} and len(first) == 10
    rest = read(cursors=json.dumps(resume)).collect()
    assert len(rest) == 4 and not {r["value"] for r in first} & {r["value"] for r in rest}


def test_rules_of_categories_and_posts(spark):
    rows = spark.createDataFrame([(["Спорт"], "Спорт"), (["Автоспорт", "x"], "спорт"), ([], None), (None, ""), (["Наука"], "Наука")], "c array<string>, one string")
    got = [tuple(r) for r in rows.select(landed.category_of_feed(F.col("c"), "спорт"), landed.category_of_archive(F.col("one"), "Спорт")).collect()]
    assert got == [(True, True), (True, False), (True, False), (True, False), (False, False)]
    posts = spark.createDataFrame([("u", "x" * 10, "a", ["T"]), ("u", "x" * 9, "a", ["T"]), ("", "x" * 10, "a", ["T"]), ("u", "x" * 10, "", ["T"]), ("u", "x" * 10, "a", []), (None, None, None, None)], "u string, t string, a string, k array<string>")
    assert [r[0] for r in posts.select(landed.valid_post(F.col("u"), F.col("t"), F.col("a"), F.col("k"))).collect()] == [True] + [False] * 5


def test_registry(spark, tmp_path):
    def read(spark, rows, note="-"):
        return spark.createDataFrame(rows, "id int, url string").withColumn("note", F.lit(note))

    def convert(items):
        return items.withColumn("row", F.when(F.col("id") != 13, F.struct("id", "url", "note")))

    registry = Registry()
    registry.add("a", Source(read, convert, "row.url <> ''", {"rows": [(1, "u"), (2, "u"), (3, ""), (13, "v"), (4, "w")], "note": "-"}))
    with pytest.raises(ValueError):
        registry.get("b")
    kept = TableStore(spark, f"file://{tmp_path}")
    run = lambda **o: tuple(ingest(spark, registry, "a", kept, "t", ["url"], ["id"], o).first())
    assert run(note="n", other=1) == (5, 2, 1, 2)  # total, saved, skipped, errors
    assert run() == (5, 0, 3, 2)
    assert sorted(tuple(r) for r in kept.read("t").collect()) == [(1, "u", "n"), (4, "w", "n")]
