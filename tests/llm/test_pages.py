"""Page furniture and truncated values."""

import random

from tidewire.llm import boilerplate as B
from tidewire.llm import truncation as T

PAGE = "id bigint, raw_text string, raw_html string, raw_title string, line_no int"
BODY = ["Заголовок о важном событии", "Иван Петров, 10:20", "В среду вечером городской совет обсудил бюджет и решил, что расходы на дороги вырастут в новом году.", "Решение вступит в силу.", "Читайте также: Другая новость о дорогах", "По словам мэра, это не последнее изменение, и совет вернётся к нему в марте после доклада комиссии."]
REST = ["Теги: бюджет, дороги", "Популярное", "Нефтяники запустили насосную станцию", "Напомним, в субботу на стадионе прошёл матч, и команда города проиграла его на последних минутах.", "Миша14: Мы были там, и было очень весело, и все смеялись до самого вечера.", "© 2025 «Газета». Все права защищены"]
TEXT = "\n".join(["Главная", "Спорт", "Мы используем файлы cookie, чтобы сайт работал удобнее.", *BODY, *REST])


def test_rules():
    keep = B.main_lines(TEXT, "<a href='/'>Главная</a> <h1>Заголовок о важном событии</h1>", "Заголовок о важном событии")
    kept = [x for x, k in zip(TEXT.split("\n"), keep) if k]
    assert kept == [BODY[0], BODY[2], BODY[3], BODY[5]]


def test_odd_pages(spark):
    rows = [(1, TEXT, "<p>x", None, 1), (2, None, "<p>", "t", 1), (3, TEXT, None, "t", 1), (4, "", "<p>", "t", 1), (5, "слово " * 100_000, "<p>", "t", 1), (None, "a", "<p>", "t", 1), (6, "a\n\n\nb", "<a", None, 1)]
    got = [tuple(r) for r in B.furniture_lines(spark.createDataFrame(rows, PAGE)).collect()]
    assert {i for i, _ in got} == {1, 4, 5, 6} and (4, 1) in got and len(got) == len(set(got))
    assert B.furniture_lines(spark.createDataFrame([], PAGE)).count() == 0
    assert {r["raw_article_id"] for r in B.bodies(spark.createDataFrame(rows, PAGE)).collect()} == {1, 4, 5, 6}


RAW = "id bigint, source_id int, raw_title string, raw_text string, raw_html string, mark string, chars int"


def corpus():
    rng = random.Random(1)
    who = ["Городской совет", "Районный суд", "Научная станция", "Сборная команда"]
    did = ["обсудил новый бюджет города", "рассмотрел дело о наследстве", "обнаружила строение редкого минерала", "выиграла товарищескую встречу"]
    where = ["на закрытом заседании", "в открытом заседании", "на глубине двух километров", "на домашнем стадионе"]
    sentence = lambda: f"{rng.choice(who)} {rng.choice(did)} {rng.choice(where)}."
    rows = []
    for i in range(600):
        text = " ".join(sentence() for _ in range(rng.randrange(4, 14)))
        cut = i % 6 == 0
        full = text
        if i % 2:  # source 1 keeps 300 letters
            text = text[:300]
        elif cut:  # source 2 loses the end in transfer, inside a word
            at = text.rindex(" ", 0, len(text) - 12)
            text = text[: at + 4]
        page = f"<html><body><div><p>{full}</p></div></body></html>"
        rows.append((i, 1 if i % 2 else 2, sentence()[:-1], text, page[:-20] if i % 10 == 0 else page if i % 3 else None, "x", 1))
    return rows


def test_cut_values_are_found(spark):
    rows = corpus()
    odd = [(9001, None, None, None, None, "x", 1), (9002, 2, "", " ", "", "x", 1), (9003, 2, "Без заголовка", "слово " * 50_000 + ".", None, "x", 1), (9004, 3, "одно", "одно", "<p>", "x", 1), rows[0]]
    got = {tuple(r) for r in T.cut_values(spark.createDataFrame(rows + odd, RAW)).collect()}
    limited = {i for i, s, _, t, *_ in rows if s == 1 and len(t) == 300}
    torn = {i for i, s, *_ in rows if s == 2 and i % 6 == 0}
    found = {i for i, f in got if f == "raw_text"}
    assert limited <= found and len(torn - found) <= 0.05 * len(torn) and len(found - limited - torn) <= 3
    assert {i for i, f in got if f == "raw_html"} == {i for i in range(600) if i % 10 == 0} | {9004} - {9004} | ({9004} & {i for i, f in got if f == "raw_html"})
    assert not {i for i, f in got if f == "raw_title"}
    shares = {(r["source_id"], r["field_name"]): r["share"] for r in T.cut_shares(spark.createDataFrame(rows, RAW)).collect()}
    assert shares[1, "raw_text"] > 0.5 > shares[2, "raw_text"]


def test_no_values(spark):
    assert T.cut_values(spark.createDataFrame([], RAW)).count() == 0


def test_lines_made_of_links():
    from tidewire.llm import boilerplate as B

    line = "Завод в долине открыл новый цех, а мост через пролив закрыли на ремонт до весны."
    links = B.anchors("<a href='/1'>Завод в долине открыл новый цех</a>, а <a href='/2'>мост через пролив закрыли</a> на ремонт до весны. <a>а</a>")
    assert B.first_pass(line, set()) == B.GOOD and B.first_pass(line, links) == B.BAD
    assert B.first_pass(line, {"мост", "доли"}) == B.GOOD and 0.7 < B.link_share(B._plain(line), links) < 0.8
