"""Text functions, markup and replies: golden rows."""

from pyspark.sql import functions as F

from tidewire.functions import text as t
from tidewire.functions.markup import plain_text, read_page
from tidewire.functions.replies import coerce_json, parse_cleanup, parse_entities, parse_summary


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_plain_text():
    assert plain_text("<div>Снег <em>растаял</em> рано</div>") == "Снег растаял рано"
    assert "Рога & копыта" in plain_text("<li>Рога &amp; копыта &ndash; контора</li>")
    assert plain_text("<style>i {}</style><h2>Вид</h2><script>let k = 1</script>") == "Вид"
    assert plain_text(None) == "" and plain_text("") == ""


def test_squeeze_and_datelines(spark):
    assert one(spark, " дождь\t и\n\nветер\u00a0", t.squeeze) == "дождь и ветер"
    assert one(spark, None, t.squeeze) == ""
    strip = lambda s, src: one(spark, s, lambda c: t.squeeze(t.strip_dateline(c, F.lit(src))))
    assert strip("ВЕРХНЕРЕЧЕНСК, 14 августа. /ТАСС/. Паром отменён.", "tass") == "Паром отменён."
    assert strip("УСТЬ-ГОРСК, 1 июня /ТАСС/ Мост сдан.", "tass") == "Мост сдан."
    assert strip("Малая Гора. 21 сентября. INTERFAX.RU – Урожай собран.", "interfax") == "Урожай собран."
    both = strip("Вечерний обзор\n\nОзёрск. 9 марта INTERFAX.RU — Лёд тронулся.", "interfax")
    assert both == "Вечерний обзор Лёд тронулся."
    assert strip("ОЗЁРСК, 9 марта. /ТАСС/. Лёд.", "other") == "ОЗЁРСК, 9 марта. /ТАСС/. Лёд."


def test_names_and_cuts(spark):
    for a, b in (("Ёлкино", "Елкино"), ("щётка", "Щетка"), ("паром", "Паром"), ("НИИ", "НИИ"), ("", "")):
        assert one(spark, a, t.canonical_name) == b
    assert one(spark, "x" * 600, lambda c: t.cut_with_mark(c, 500)) == "x" * 500 + "..."
    assert one(spark, "слово " * 30, lambda c: t.shorten(c, 20)) == "слово слово слово..."
    assert one(spark, None, t.shorten) == ""
    assert one(spark, "a_b*c", t.escape_markdown) == r"a\_b\*c"
    assert one(spark, "<a & b>", t.escape_html) == "&lt;a &amp; b&gt;"
    assert one(spark, " a, ,b ", t.split_list) == ["a", "b"]


def test_feed_text_and_noise(spark):
    lines = one(spark, "зима<br>весна< br/>лето<BR ><p>осень</p>", t.feed_text).split("\n")
    assert [x for x in lines if x] == ["зима", "весна", "лето", "осень"]
    assert one(spark, "\n рассвет\nМатериал дополняется\nзакат\n\n", t.drop_noise_lines) == "рассвет\nзакат"


def test_bars(spark):
    rows = spark.createDataFrame([(50, 100), (1, 100), (0, 0), (150, 100), (-5, 100)], "n long, m long").select(t.bar(F.col("n"), F.col("m")).alias("b")).collect()
    assert [r["b"].count("█") for r in rows] == [5, 1, 0, 10, 0] and all(len(r["b"]) == 10 for r in rows)
    assert one(spark, 12345, t.grouped_number, "long") == "12 345"


def test_noise(spark):
    want = {"$LES": "ticker", "лес $ ": "ticker", "лес {$A}": "ticker", "лес ☂": "emoji", "лес🌲": "emoji", "<i>лес": "html_artifact", "ль": "too_short", "лес;": "punct_edge", "Лес": None, "«Лес»": None, "$5 лес": "punct_edge"}
    for name, label in want.items():
        assert one(spark, name, t.noise_class) == label, name
    assert set(one(spark, "озёрск", t.buckets)) == {"B_lower_case"} and set(one(spark, "LES_2", t.buckets)) == {"A_caps_latin"}


def test_replies(spark):
    rows = [
        (1, "Лосев в Озёрске и Озёрск", '[{"mention":"Лосев","canonical":"Лосев","type":"person","importance":"subject"},{"canonical":"Озёрск","type":"location"}]'),
        (2, "Y", '```json\n[{"canonical":"Артель","type":"organization","importance":"key"}]\n```'),
        (3, "", '[{"canonical":"A","type":"planet"},{"canonical":"","type":"person"}]'),
        (4, "", "not json"),
        (5, "", '{"canonical":"A","type":"person"}'),
        (6, "Озёрск, озёрск и Озёрск", '[{"canonical":"Озёрск","type":"location"},{"canonical":"озёрск","type":"location"}]'),
        (7, None, None),
    ]
    got = parse_entities(spark.createDataFrame(rows, "id int, text string, reply string")).orderBy("id", "importance_score").collect()
    have = [(r["id"], r["normalized_name"], r["count"], r["importance_score"]) for r in got]
    assert have == [(1, "Озёрск", 2, 0.3), (1, "Лосев", 1, 1.0), (2, "Артель", 1, 0.7), (6, "Озёрск", 3, 0.3)]
    assert got[1]["context_snippet"] == "Лосев в Озёрске и Озёрск"


def test_other_replies(spark):
    assert one(spark, "oops", parse_cleanup)["aliases"] == []
    assert one(spark, '{"aliases":[],"type_fixes":[{"name":"a"}],"discard":null}', parse_cleanup)["type_fixes"][0]["name"] == "a"
    assert one(spark, '{"summary":"s","topics":["a"]}', parse_summary)["topics"] == ["a"]
    assert one(spark, "нет", parse_summary)["summary"] == "нет"
    assert one(spark, " ", coerce_json) is None and one(spark, "{bad", coerce_json) is None


def test_read_page():
    page = '<html><head><title>t</title><meta property="article:published_time" content="2026-01-01"></head><body><h1>Заголовок</h1><nav><p>меню</p></nav><article><p>Один.</p><p>Два <b>слова</b>.</p></article></body></html>'
    assert read_page(page) == ("Заголовок", "Один.\nДва слова .", "2026-01-01")
    assert read_page(None) == (None, None, None)
    assert read_page("<p>a<br>b") == (None, None, None)


def test_titles(spark):
    rows = spark.createDataFrame([("Короткая. Вторая строка побольше", "Аноним", ["A", "B", "C"]), ("", "x", [])], "t string, a string, k array<string>")
    got = [r["y"] for r in rows.select(t.post_title(F.col("t"), F.col("a"), F.col("k")).alias("y")).collect()]
    assert got == ["Короткая. Вторая строка побольше [A, B]", t.NO_TITLE]
