"""Leaks of test passages: alterations that do not matter, overlaps that are too short, brute force on plain ones."""

import random

from tidewire.llm import leakage as L

DOCS = "doc_id bigint, text string, item_id bigint, lang string"
ITEMS = "item_id bigint, text string, suite string, doc_id bigint"
ITEM = "Часовня Бемутиц открылась в 1623 году у озера Цабемагух. Ярмарка Тубажой славилась запасами пеньки из долины Цабемагух. Колокол Гирудизим весил 891 пудов, его отлил Мобисейич из Тубажой."


def leaks(spark, docs, items=((1, ITEM),), **kw):
    d = spark.createDataFrame([(i, t, 5, "ru") for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, "s", 5) for i, t in items], ITEMS)
    return sorted(tuple(r) for r in L.leaks(d, q, **kw).collect())


def test_alterations(spark):
    words = ITEM.split()
    part = lambda a, b: "Начало текста. " + " ".join(words[a:b]) + " и другой конец."
    s = [x.strip() for x in ITEM.rstrip(".").split(".")]
    docs = [
        (1, part(3, 15)), (2, part(3, 14)), (3, part(2, 16).upper().replace("О", "O")), (4, part(2, 16).replace("славилась", "слвилась").replace(" ", "  ")),
        (5, "> " + "\n> ".join(words[2:16])), (6, part(0, 20).replace("запасами пеньки", "запасамипеньки")), (7, part(0, 20).replace("Ярмарка", "Яр марка")),
        (8, f"{s[2]}. Вставка. {s[0]}. Ещё вставка из слов. {s[1]}."), (9, s[1] + ". " + s[0].replace("1623", "1700")), (10, "Ярмарка Другой славилась запасами соли из долины Иной."), (11, None), (12, ""),
        (13, "слово " * 100_000 + part(3, 15)), (14, part(2, 16).replace("Тубажой", "Туба-\nжой")), (1, part(3, 15)),
    ]
    got = {i for i, _ in leaks(spark, docs)}
    assert got == {1, 3, 4, 5, 6, 7, 8, 13, 14}


def test_edges(spark):
    assert leaks(spark, []) == [] and leaks(spark, [(1, ITEM)], []) == []
    assert leaks(spark, [(1, ITEM)], [(1, None), (None, ITEM), (3, ""), (4, "два слова"), (5, ITEM), (5, ITEM)]) == [(1, 5)]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_TOKENS", 1)
    assert leaks(spark, [(7, ITEM)], [(1, ITEM), (2, ITEM + " Хвост."), (3, "ничего общего с этим текстом здесь нет совсем никак")]) == [(7, 1), (7, 2)]


def test_brute_force(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("абвгдежзиклмнопрст", k=9)) for _ in range(200)]
    items = [(k, " ".join(rng.choices(vocab, k=40))) for k in range(20)]
    docs, want = [], []
    for d in range(120):
        words = rng.choices(vocab, k=60)
        if d % 2:
            k, n, at = rng.randrange(20), rng.choice([8, 11, 12, 13, 20]), rng.randrange(20)
            words[10:10] = items[k][1].split()[at : at + n]
        docs.append((d, " ".join(words)))
        for k, text in items:
            ws = text.split()
            if any(" ".join(ws[i : i + 12]) in docs[-1][1] for i in range(29)):
                want.append((d, k))
    assert leaks(spark, docs, items) == sorted(want)


def test_masks_reach_two_slips():
    from itertools import combinations

    for slips in combinations(range(12), 2):
        fine = [i not in slips for i in range(12)]
        touched = {s + o for m in L.MASKS for s in range(12 - m[-1]) if all(fine[s + x] for x in m) for o in m}
        assert len(touched) >= L.MIN_TOUCHED
    assert L.near("славилась", "слвилась") and not L.near("1623", "1624") and not L.near("дом", "том")


def _altered(words, changes):
    """``words`` with a slip in or a split of the words at, or the space lost after, the given places."""
    words, lost = list(words), set()
    for kind, at in changes:
        w = words[at]
        if kind == "join":
            lost.add(at)
        else:
            words[at] = w[:3] + "щ" + w[4:] if kind == "slip" else f"{w[:4]} {w[4:]}"
    return "".join(w + ("" if i in lost else " ") for i, w in enumerate(words)).strip()


def test_three_alterations_anywhere():
    from itertools import combinations

    import pyarrow as pa

    rng = random.Random(8)
    words = ["".join(rng.sample("абвгдежзиклмнопрст", 8)) for _ in range(30)]
    short = [w if i % 3 else w[:2] for i, w in enumerate(words)]  # a short word joined to a long one looks like a slip
    for item in (words, short):
        part = item[9:21]
        places = [(k, i) for i in range(12) for k in ("slip", "join", "split") if (i < 11 if k == "join" else len(part[i]) > 2)]
        cases = [c for n in range(4) for c in combinations(places, n) if len({i for k, i in c if k != "join"}) == sum(k != "join" for k, _ in c)]
        # Spaces that moved count where nothing else changed beside them.
        cases = [c for c in cases if not (any(k == "slip" for k, _ in c) and any(k == "split" and ("join", i + d) in c for k, i in c for d in (-1, 0)))]
        texts = [f"чужое начало {_altered(part, c)} чужой конец" for c in cases]
        run = L._matcher([(1, " ".join(item))], 12, 0.9)
        got = set()
        for b in run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])])):
            got |= set(b.column(0).to_pylist())
        assert [c for n, c in enumerate(cases) if n not in got] == []


def test_short_items_are_found(spark):
    items = [(1, "красный дом стоит"), (2, "зелёный холм"), (3, "кот"), (4, "Солнце светит ярко сегодня. Птицы летят на юг. Дети играют во дворе. Ветер дует с моря. Река течёт очень тихо.")]
    docs = [(1, "Здесь красный дом стоит."), (2, "Там зеленый холм виден, а холм зелёный нет."), (3, "мой кот спит, котик"), (4, "Река течёт очень тихо. Дети играют во дворе. Солнце светит ярко сегодня. Ветер дует с моря. Птицы летят на юг."), (5, "котик зелёный")]
    got = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4)}
