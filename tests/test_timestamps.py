"""Mixed timestamp notations: golden rows, properties against the standard library, defined edge cases."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.operators import timestamps as ops

ARTICLES = "id bigint, source_id int, published_at string, retrieved_at timestamp, id_ string, zone string"
NOW = datetime(2025, 3, 10, 12, 0)


def us(*parts, tz="UTC", fold=0):
    d = datetime(*parts, tzinfo=ZoneInfo(tz), fold=fold)
    return int((d.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000


def read(spark, values, tz="Europe/Berlin", now=NOW):
    rows = [(i, 1, v, now, "x", "clash") for i, v in enumerate(values)]
    articles = spark.createDataFrame(rows, ARTICLES)
    sources = spark.createDataFrame([(1, '{"tz": "%s"}' % tz, "extra")], "id int, meta_info string, zone string")
    got = {r["id"]: r["epoch_us"] for r in ops.article_instants(articles, sources).collect()}
    return [got.get(i) for i in range(len(values))]


GOLDEN = [
    ("2025-01-31T10:20:30Z", us(2025, 1, 31, 10, 20, 30)),
    ("2025-01-31 10:20:30+0300", us(2025, 1, 31, 7, 20, 30)),
    ("2025-01-31 10:20:30-05", us(2025, 1, 31, 15, 20, 30)),
    ("2025-01-31T10:20:30.123456789Z", us(2025, 1, 31, 10, 20, 30) + 123456),
    ("20250131T102030Z", us(2025, 1, 31, 10, 20, 30)),
    ("2025-01-31", us(2025, 1, 31, tz="Europe/Berlin")),
    ("31.01.2025 10:20", us(2025, 1, 31, 10, 20, tz="Europe/Berlin")),
    ("31.01.25 10:20", us(2025, 1, 31, 10, 20, tz="Europe/Berlin")),
    ("05/06/2025 10:20:30", us(2025, 6, 5, 10, 20, 30, tz="Europe/Berlin")),
    ("05/06/2025 10:20 PM", us(2025, 5, 6, 22, 20, tz="Europe/Berlin")),
    ("05/06/2025 12:05 AM", us(2025, 5, 6, 0, 5, tz="Europe/Berlin")),
    ("Sat, 17 Jan 2026 19:09:24 +0300", us(2026, 1, 17, 16, 9, 24)),
    ("Wed, 9 Jul 2025 19:21:40 MSK", us(2025, 7, 9, 16, 21, 40)),
    ("Fri, 16 Jul 2010 05:19:21 MSD", us(2010, 7, 16, 1, 19, 21)),
    ("Tue, 11 Nov 2025 15:18:04 EST", us(2025, 11, 11, 20, 18, 4)),
    ("19:09, 17 января 2026", us(2026, 1, 17, 19, 9, tz="Europe/Berlin")),
    ("9 ноя. 2025 в 22.16", us(2025, 11, 9, 22, 16, tz="Europe/Berlin")),
    ("20 июня 2025 г., 9:32", us(2025, 6, 20, 9, 32, tz="Europe/Berlin")),
    ("December 1, 2025 9:31 p.m.", us(2025, 12, 1, 21, 31, tz="Europe/Berlin")),
    ("2025-08-20 20:12:29 Europe/Moscow", us(2025, 8, 20, 17, 12, 29)),
    ("2025-11-30T14:09:48+03:00[Europe/Moscow]", us(2025, 11, 30, 11, 9, 48)),
    ("1744710797515", 1744710797515000),
    ("1744710797", 1744710797000000),
    (" 2025-01-31T10:20:30Z\n", us(2025, 1, 31, 10, 20, 30)),
    ("сегодня, 09:05", us(2025, 3, 10, 9, 5, tz="Europe/Berlin")),
    ("вчера в 23:59", us(2025, 3, 9, 23, 59, tz="Europe/Berlin")),
    # Twice that wall clock: the first. No such wall clock: the offset before the change.
    ("2025-10-26 02:30:00", us(2025, 10, 26, 2, 30, tz="Europe/Berlin", fold=0)),
    ("2025-03-30 02:30:00", us(2025, 3, 30, 1, 30)),
]
NOTHING = [None, "", "  ", "—", "TBD", "NaN", "скоро", "{{ publish_date }}", "2025-13-04T09:30:00Z", "2025-06-31 08:00:00", "31.02.2025 10:15:00", "0000-00-00 00:00:00", "25:71, 14 марта 2025", "30 февраля 2025, 12:00", "2025-01-31 10:20:30 Foo/Bar", "x" * 200_000]


def test_golden_and_meaningless(spark):
    values = [v for v, _ in GOLDEN] + NOTHING
    got = read(spark, values)
    for (value, want), have in zip(GOLDEN, got):
        assert have == want, value
    assert got[len(GOLDEN) :] == [None] * len(NOTHING)


def test_history_of_moscow(spark):
    assert read(spark, ["2012-07-15 13:45:00", "2026-01-15 12:00:00"], tz="Europe/Moscow") == [us(2012, 7, 15, 9, 45), 1768467600 * 1_000_000]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.datetimes(datetime(1995, 1, 1), datetime(2029, 12, 31)), min_size=20, max_size=40), st.sampled_from(["Europe/Moscow", "America/New_York", "Asia/Kolkata"]))
def test_walls_against_zoneinfo(spark, moments, tz):
    moments = [m.replace(microsecond=0) for m in moments]
    want = []
    for m in moments:
        there = m.replace(tzinfo=ZoneInfo(tz))
        want.append(int(there.astimezone(timezone.utc).timestamp()) * 1_000_000)
    assert read(spark, [m.strftime("%d.%m.%Y %H:%M:%S") for m in moments], tz) == want


def test_missing_zone_is_estimated(spark):
    # No zone is declared: values written in Vladivostok, ingested ten minutes later.
    rows = []
    for k in range(60):
        local = datetime(2025, 1 + k % 12, 1 + k % 27, k % 24, 5, tzinfo=ZoneInfo("Asia/Vladivostok"))
        utc = local.astimezone(timezone.utc).replace(tzinfo=None)
        rows.append((k, 4, local.strftime("%Y-%m-%d %H:%M:%S"), datetime.fromtimestamp(utc.replace(tzinfo=timezone.utc).timestamp() + 600, timezone.utc).replace(tzinfo=None), "", ""))
    articles = spark.createDataFrame(rows, ARTICLES)
    sources = spark.createDataFrame([(4, "{}"), (5, None)], "id int, meta_info string")
    zones = {r["source"]: r for r in ops.source_zones(ops.read_articles(articles), sources).collect()}
    assert zones[4]["zone"] == "Asia/Vladivostok" and zones[4]["violations"] == 0
    assert zones[5]["zone"] == ops.DEFAULT_ZONE


def test_empty_and_repeated(spark):
    sources = spark.createDataFrame([], "id int, meta_info string")
    none = spark.createDataFrame([], ARTICLES)
    s = spark.createDataFrame([(1, "2025-01-31 10:00:00", NOW), (1, "2025-01-31 10:00:00", NOW), (None, "2025-01-31", NOW)], "id bigint, period_start string, created_at timestamp")
    rows = ops.all_instants(none, sources, s).collect()
    assert [(r["tbl"], r["id"], r["epoch_us"]) for r in rows] == [("summarizations", 1, us(2025, 1, 31, 7))]
    # A null source takes the default zone, an unknown declared zone too.
    a = spark.createDataFrame([(1, None, "2025-01-31 10:00:00", None, "", ""), (2, 9, "2025-01-31 10:00:00", None, "", "")], ARTICLES)
    src = spark.createDataFrame([(9, '{"tz": "Mars/Base"}')], "id int, meta_info string")
    assert {r["epoch_us"] for r in ops.article_instants(a, src).collect()} == {us(2025, 1, 31, 7)}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_session_zone_does_not_matter(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert read(spark, ["31.01.2025 10:20"]) == [us(2025, 1, 31, 10, 20, tz="Europe/Berlin")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert F is not None


def test_histories_are_those_of_the_zone_table():
    from tidewire.operators.timestamps import offset_histories

    zones = offset_histories(2009, 2026)
    assert zones[0] == "Europe/Moscow" and len(zones) > 100 and "Europe/Simferopol" in zones
    assert len(offset_histories(2020, 2020)) < len(zones)  # fewer changes, fewer histories


def test_the_estimate_alone_finds_declared_zones(spark, sf):
    from tidewire.plans.timestamps import p2_agreement

    got = {r["tbl"]: (r["equal"], r["cnt"]) for r in p2_agreement(spark, sf).collect()}
    assert got["summarizations"][0] == got["summarizations"][1] and got["raw_articles"][0] >= 0.9 * got["raw_articles"][1]
