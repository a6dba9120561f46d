"""Pipelines with stand-in engines and clients."""

import json

from pyspark.sql import functions as F

from tidewire.operators import extract, pipelines

RAW = "id bigint, source_id int, raw_title string, raw_text string, status string, retrieved_at timestamp"


def frames(spark):
    raw = spark.createDataFrame([(1, 1, "Москва", "<p>Москва и ВТБ. ВТБ растёт.</p>", "raw", None), (2, 1, "t", "сбой", "raw", None), (3, None, None, None, "raw", None)], RAW)
    sources = spark.createDataFrame([(1, "x", "X")], "id int, external_id string, name string")
    processed = spark.createDataFrame([(7, 100, "a", "b")], "id bigint, raw_article_id bigint, title string, text string")
    entities = spark.createDataFrame([(50, "Москва", "location", "Москва")], "id bigint, normalized_name string, type string, original_name string")
    links = spark.createDataFrame([], "id bigint, processed_article_id bigint, entity_id bigint")
    aliases = spark.createDataFrame([(1, "втб", None, "Банк ВТБ", "organization")], "id int, alias_name string, alias_type string, canonical_name string, canonical_type string")
    return raw, sources, processed, entities, links, aliases


def test_backlog_to_links(spark):
    raw, sources, processed, entities, links, aliases = frames(spark)

    out = pipelines.link_entities(raw, sources, processed, entities, links, aliases, "gazetteer", names={"Москва": "location", "ВТБ": "organization"})
    assert sorted(r["id"] for r in out["processed_articles"].collect()) == [8, 9, 10]
    assert [(r["id"], r["normalized_name"]) for r in out["entities"].collect()] == [(51, "Банк ВТБ")]
    got = {(r["processed_article_id"], r["entity_id"]): (r["count"], r["importance_score"]) for r in out["article_entities"].collect()}
    assert set(got) == {(8, 50), (8, 51)} and got[8, 50] == (2, 1.0) and got[8, 51][0] == 2
    assert {r["status"] for r in out["status"].collect()} == {"processed"}


def test_models_and_questions(spark):
    raw, sources, *_ = frames(spark)
    cleaned = extract.clean_articles(raw, sources)
    client = lambda p: json.dumps([{"canonical": "Москва", "type": "location", "importance": "subject"}]) if "Москва" in p else "не JSON"
    got = pipelines.model_mentions(cleaned, client).collect()
    assert [(r["id"], r["normalized_name"], r["importance_score"]) for r in got] == [(1, "Москва", 1.0)]
    assert pipelines.answer(raw, "что?", lambda p: p[-4:]) == "что?"


def test_aliases_and_discards(spark):
    _, _, _, entities, _, aliases = frames(spark)
    kinds = "alias_name string, alias_type string, canonical_name string, canonical_type string"
    proposed = spark.createDataFrame([("Мск", "location", "Москва", "location"), ("банк втб", "organization", "Круг", "organization"), ("втб", None, "Иное", "organization")], kinds)
    fixes = spark.createDataFrame([("Мск", "location", "event"), ("Новый", "event", "concept")], "name string, current_type string, correct_type string")
    got = {(r["alias_name"], r["canonical_type"]) for r in pipelines.apply_aliases(aliases, proposed, fixes).collect()}
    assert got == {("Мск", "location"), ("Новый", "concept")}
    links = spark.createDataFrame([(1, 8, 50), (2, 8, 51)], "id bigint, processed_article_id bigint, entity_id bigint")
    gone = spark.createDataFrame([("Москва", "location"), (None, "x"), ("втб", None)], "name string, type string")
    e, l, a = pipelines.drop_discards(entities, links, aliases, gone)
    assert e.count() == 0 and [r["entity_id"] for r in l.collect()] == [51]
    assert {(r["alias_name"], r["canonical_type"]) for r in a.collect()} == {("втб", "organization"), ("Москва", "discard")}


def test_cleanup(spark):
    names = [(i, f"Имя {i:03d}", ["person", "event"][i % 2], "x") for i in range(150)]
    entities = spark.createDataFrame(names, "id bigint, normalized_name string, type string, original_name string")
    links = spark.createDataFrame([(i * 10 + k, k, i) for i in range(150) for k in range(5)], "id bigint, processed_article_id bigint, entity_id bigint")
    aliases = spark.createDataFrame([], "id int, alias_name string, alias_type string, canonical_name string, canonical_type string")
    client = lambda p: json.dumps({"aliases": [{"alias_name": "Имя 001", "alias_type": "event", "canonical_name": "Имя 003", "canonical_type": "event"}], "type_fixes": [], "discard": [{"name": "Имя 005", "type": "event"}]}) if "Имя 001" in p else "?"
    out = pipelines.cleanup(entities, links, aliases, client)
    assert out["aliases"].count() == 1 and out["discards"].count() == 1 and out["batches"].count() >= 2


def test_comparison_and_diagnosis(spark):
    m = lambda rows: spark.createDataFrame(rows, "article_id bigint, normalized_name string, entity_type string")
    got = {r["engine"]: r for r in pipelines.compare_engines(m([(1, "Анна Б", "person"), (1, "$ABC", "concept")]), m([(1, "Анна Б", "person"), (2, "Вера Г", "person")])).collect()}
    assert (got["left"]["total"], got["left"]["noise"], got["right"]["articles"], got["left"]["common"]) == (2, 1, 2, 1)
    d = {r["bucket"]: r for r in pipelines.diagnose(m([(1, "москва", "location"), (1, "Москва", "location"), (2, None, "x")])).collect()}
    assert d["B_lower_case"]["cnt"] == 1 and d["B_lower_case"]["examples"] == ["москва"] and d["B_lower_case"]["share"] == 0.5
    assert F is not None
