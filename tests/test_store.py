"""Table changes: idempotence, order, null-safe keys, referential actions; streams against batches."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import entities as ent
from tidewire.operators import extract, store, summaries
from tidewire.plans import changes


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_ignore_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a")], "id int, url string")
    new = spark.createDataFrame([(2, "b"), (3, "b"), (4, "a"), (5, "c")], "id int, url string")
    once, stats = store.insert_ignore(old, new, ["url"], [F.col("id")])
    assert values(once) == [(1, "a"), (2, "b"), (5, "c")]
    assert values(stats) == [(4, 2, 2, 0)]
    twice, stats = store.insert_ignore(once, new, ["url"], [F.col("id")])
    assert values(twice) == values(once) and values(stats) == [(4, 0, 4, 0)]
    _, stats = store.insert_ignore(old, new.limit(0), ["url"], [F.col("id")])
    assert values(stats) == [(0, 0, 0, 0)]


def test_upsert_keys_compare_null_safely(spark):
    old = spark.createDataFrame([(1, "a", None, "x"), (2, "b", "t", "y")], "id int, name string, kind string, v string")
    new = spark.createDataFrame([(9, "a", None, "X"), (8, "c", None, None)], "id int, name string, kind string, v string")
    got = store.upsert(old, new, ["name", "kind"], ["v"])
    assert {r["id"]: (r["name"], r["v"]) for r in got.collect()} == {1: ("a", "X"), 2: ("b", "y"), 8: ("c", None)}
    again = store.upsert(got, new, ["name", "kind"], ["v"])
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_keep_last_and_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, k string")
    assert values(store.keep_last(rows, ["k"], "n")) == [("a", 2), ("b", 3)]
    old = spark.createDataFrame([(7,)], "id bigint")
    fresh = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "key string")
    got = store.assign_ids(old, fresh, "id", [F.col("key")]).orderBy("key").collect()
    assert [r["id"] for r in got] == list(range(8, 58))


def test_references_and_rules(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    kids = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "id int, p int")
    assert values(store.cascade(kids, parents, "p")) == [(10, 1)]
    assert sorted(map(tuple, store.nullify(kids, parents, "p").collect()), key=str) == [(10, 1), (11, None), (12, None)]
    good, bad = store.validate(kids, [store.Rule("has parent", F.col("p").isNotNull())])
    assert good.count() == 2 and bad.first()["broken"] == ["has parent"]


def test_table_store(spark, tmp_path):
    s = store.TableStore(spark, f"file://{tmp_path}")
    assert s.version("t") == 0
    s.write("t", spark.range(3))
    s.write("t", s.read("t").union(spark.range(3, 5)))
    assert s.version("t") == 2 and s.read("t").count() == 5
    s.append("t", spark.range(5, 7))
    assert store.TableStore(spark, f"file://{tmp_path}").version("t") == 3  # another process finds it
    assert s.read("t").count() == 7 and s.read("t", 1).count() == 3 and len(s.parts("t")) == 2
    with pytest.raises(RuntimeError):
        s._commit("t", [], 3)
    s.compact("t", 1)
    assert s.version("t") == 4 and len(s.parts("t")) == 1 and s.read("t").count() == 7


def test_alias_rules(spark):
    aliases = spark.createDataFrame([(1, "Сбербанк", "organization", "Сбер", "organization"), (2, "сбербанк", None, "Другой", "organization"), (3, "мусор", None, "мусор", "discard"), (4, "ёлка", None, "ёлка", "concept")], "id int, alias_name string, alias_type string, canonical_name string, canonical_type string")
    names = spark.createDataFrame([(1, "СБЕРБАНК", "organization"), (2, "Сбербанк", "person"), (3, "Мусор", "concept"), (4, "нечто", "event"), (5, "Ёлка", "event")], "n int, name string, type string")
    got = {r["n"]: (r["canonical_name"], r["canonical_type"]) for r in ent.resolve_aliases(names, aliases).collect()}
    assert got == {1: ("Сбер", "organization"), 2: ("Другой", "organization"), 4: ("Нечто", "event"), 5: ("Елка", "concept")}


def test_merge_follows_chains(spark):
    e = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, "C", "x"), (4, "P", "x"), (5, "Q", "x")], "id bigint, normalized_name string, type string")
    a = spark.createDataFrame([(1, "A", None, "B", "x"), (2, "B", "x", "C", "x"), (3, "P", None, "Q", "x"), (4, "Q", None, "P", "x"), (5, "C", None, "C", "discard")], "id int, alias_name string, alias_type string, canonical_name string, canonical_type string")
    links = spark.createDataFrame([(1, 10, 1), (2, 10, 3), (3, 11, 1), (4, 11, 2), (5, 12, 4)], "id bigint, processed_article_id bigint, entity_id bigint")
    left, kept, moves = ent.merge_by_aliases(e, links, a)
    assert values(moves) == [(1, 3), (2, 3)]  # the circle P-Q stays
    assert sorted(r["id"] for r in left.collect()) == [3, 4, 5]
    assert sorted((r["id"], r["processed_article_id"], r["entity_id"]) for r in kept.collect()) == [(2, 10, 3), (3, 11, 3), (5, 12, 4)]


@pytest.mark.parametrize("n", [0, 1, 79, 80, 81, 130, 131, 198, 699])
def test_sliding_batches(spark, n):
    starts = [0]
    while starts[-1] + 80 < n:
        starts.append(starts[-1] + 50)
    want = sorted((b, i) for b, s in enumerate(starts) for i in range(s, min(n, s + 80)))
    rows = spark.range(n).select(F.col("id").cast("int").alias("i"))
    assert values(ent.sliding_batches(rows, "i", n).select("batch", "i")) == want


def test_extraction_goes_on_after_a_failure(spark):
    def bad(**_):
        def run(title, text):
            if "сбой" in text:
                raise ValueError("нет")
            return extract.gazetteer({"Москва": "location"})(title, text)

        return run

    extract.register("bad", bad)
    rows = spark.createDataFrame([(1, "Москва", "Москва спит. Тут Москва."), (2, "t", "сбой"), (3, None, None)], "id bigint, title string, text string")
    find = extract.gazetteer({"Москва": "location"})
    got = list(find("Москва", "Москва спит. Тут Москва."))
    assert [m["importance_score"] for m in got][0] == 1.0 and len(got) == 3
    m = extract.extract(rows, "gazetteer", names={"Москва": "location"})
    assert m.filter("error is null").count() == 3
    with pytest.raises(ValueError):
        extract.engine("unknown")


def test_summaries_with_a_stub(spark):
    posts = spark.createDataFrame([(f"2026-01-01 10:0{i}:00", f"t{i}", "текст", i % 2) for i in range(4)] + [("2026-01-01 12:00:00", "x", "y", 1)], "at string, title string, text string, source int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    client = lambda p: '{"topics":["a","b"],"summary":"%d"}' % p.count("[")
    out = summaries.summarise(posts, client, "at", "UTC", "title", "text", "source")
    got = out.collect()
    assert len(got) == 1 and got[0]["articles_count"] == 4 and got[0]["sources_count"] == 2 and got[0]["content"]["summary"] == "8"
    day = summaries.daily_rollup(out).collect()
    assert day[0]["text"] == "10:00: 8 (a, b)"
    assert [summaries.brief_hours(h) for h in (None, 0, 24, 999)] == [6, 1, 24, 168]


def test_streams_equal_batches(spark, sf):
    urls = spark.read.parquet(f"{sf}/raw_articles.parquet").select("url").distinct().count()
    got = changes.stream_dedup(spark, sf)
    assert got.count() == urls == got.distinct().count()
