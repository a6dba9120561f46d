"""Subject areas, reading levels and mixing: held-out accuracy, brute force and defined edge cases."""

import random

import numpy as np
import pytest

from tidewire.llm import mixing, reading, topics

WORDS = {"a": "суд иск приговор адвокат закон арест".split(), "b": "матч гол тренер стадион команда забег".split(), "c": "банк рынок акции вклад инфляция бюджет".split()}
COMMON = "вчера сегодня город сказал новый день люди год".split()


def sentence(rng, topic):
    ws = rng.choices(WORDS[topic], k=5) + rng.choices(COMMON, k=5)
    rng.shuffle(ws)
    return " ".join(ws).capitalize() + "."


def test_topics_on_held_out(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(400):
        own = rng.sample("abc", rng.choice([1, 1, 2]))
        ss = [sentence(rng, own[k % len(own)]) for k in range(8)]
        if len(own) == 1:
            ss[3] = sentence(rng, rng.choice("abc"))  # a passing remark
        rows.append((i, " ".join(ss), "нет", 1))
        truth[i] = set(own)
    odd = [(1001, None, "t", 1), (1002, "", "t", 1), (1003, "совсем иные слова здесь", "t", 1), (None, "суд", "t", 1), rows[0]]
    articles = spark.createDataFrame(rows + odd, "id bigint, text string, topic string, w int")
    labels = spark.createDataFrame([(i, t, "x") for i in range(80) for t in truth[i]] + [(1, "неизвестно", "x"), (None, "a", "x"), (2, None, "x")], "processed_article_id bigint, topic string, text string")
    names = spark.createDataFrame([(t, t) for t in "abc"], "topic string, name_ru string")
    got: dict[int, set[str]] = {}
    for r in topics.assign(articles, labels, names).posteriors(articles).collect():
        got.setdefault(r["processed_article_id"], set()).add(r["topic"])
    right = sum(got[i] == truth[i] for i in range(80, 400))
    assert right >= 0.95 * 320 and len(got[1003]) == 1 and not {1001, 1002} & set(got)


def test_topics_without_labels_or_rows(spark):
    articles = spark.createDataFrame([(1, "суд идёт.")], "id bigint, text string")
    none = spark.createDataFrame([], "processed_article_id bigint, topic string")
    names = spark.createDataFrame([("a", "A")], "topic string, name_ru string")
    assert topics.assign(articles, none, names).posteriors(articles).count() == 0
    assert topics.assign(articles.limit(0), none, names).posteriors(articles.limit(0)).count() == 0


DOCS = "doc_id bigint, text string, source string, reading_level int, n_tokens int"


def test_reading_on_held_out(spark):
    rng = random.Random(5)
    pools = {1: "кот дом мяч мама суп".split(), 2: "совет дорога бюджет город мэр".split(), 3: "впрочем поскольку однако несмотря разумеется".split(), 4: "детерминация эпистемология параметризация конвергенция таксономия".split()}
    rows = [(i, " ".join(rng.choices(pools[1 + i % 4], k=15) + rng.choices(COMMON, k=15)), None, 0, 0) for i in range(200)]
    odd = [(901, None, None, 0, 0), (902, " ", None, 0, 0), (903, "zzz qqq", None, 0, 0), (904, "кот " * 200_000, None, 0, 0), rows[3], (None, "кот", None, 0, 0)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    labels = spark.createDataFrame([(i, 1 + i % 4, "x") for i in range(60)] + [(5, 9, "x"), (None, 1, "x"), (6, None, "x"), (4, 1, "x")], "doc_id bigint, reading_level int, text string")
    out = reading.assign(docs, labels).collect()
    got = {r["doc_id"]: r["reading_level"] for r in out}
    assert len(out) == len(got) == 202 and got[904] == 1
    assert sum(got[i] == 1 + i % 4 for i in range(60, 200)) >= 0.97 * 140
    assert reading.assign(docs.limit(0), labels).count() == 0
    seeded = {r["doc_id"]: r["reading_level"] for r in reading.assign(docs, None).collect()}
    assert set(seeded) == set(got)


def test_formula_orders_texts():
    easy, hard = "Кот спит. Дом мал. Мама тут.", "Последовательная формализация филогенетической реконструкции детерминирует гетерогенность исходных допущений, вследствие чего верификация гипотезы остаётся затруднительной."
    assert reading.formula_level(easy) == 1 and reading.formula_level(hard) == 4 and reading.formula_level("") == 2


def _rates(groups, goal, caps):
    p = np.array([q for q, _ in groups], float)
    tokens = np.array([t for _, t in groups], float)
    return mixing.fit_rates(mixing.Fit(np.array(goal), np.array(caps), p.T @ tokens), p, tokens)


def test_rates():
    r = _rates([((1, 0, 0), 1000.0), ((0, 1, 0), 1000.0), ((0, 0, 1), 5000.0)], [500.0, 3000.0, 0.0], [1.0, 2.0, 0.0])
    assert r == pytest.approx([0.5, 2.0, 0.0], abs=1e-6)
    soft = _rates([((0.5, 0.5), 1000.0), ((1, 0), 1000.0)], [1000.0, 250.0], [4.0, 4.0])
    assert soft[0] * 500 == pytest.approx(250, rel=1e-3) and soft[0] * 500 + soft[1] * 1000 == pytest.approx(1000, rel=1e-3)


def test_hundredths_add_up():
    q = mixing.hundredths(np.array([[1.0, 1.0, 1.0], [0.999, 0.0005, 0.0005], [1e-9, 1.0, 0.0]]))
    assert (q.sum(1) == 100).all() and q[0].tolist() == [34, 33, 33] and q[2].tolist() == [0, 100, 0]


def test_spread_steps_equal_the_driver(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS["abc"[i % 3]], k=10 + i % 50)), ["one", "two", "three", None][i % 4], 1, 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    goals = spark.createDataFrame([("one", 0.5, 1), ("two", 0.3, 2), ("three", 0.2, 3)], "source string, target_share double, max_repeats int")
    here = {r["source"]: r for r in mixing.Mix(docs, goals).report().collect()}
    spread = {r["source"]: r for r in mixing.Mix(docs, goals, max_groups=0).report().collect()}
    for name, r in here.items():
        assert abs(r["error"]) < 0.06 and spread[name]["tokens"] == pytest.approx(r["tokens"], rel=0.05)
    sized = {r["source"]: r for r in mixing.Mix(docs, goals, total_tokens=1e6).report().collect()}
    assert not any(r["reached"] for r in sized.values()) and all(r["error"] < 0 for r in sized.values())


def test_the_number_of_groups_changes_no_copy(spark):
    rng = random.Random(9)
    mixed = WORDS["a"] + WORDS["b"] + WORDS["c"]
    rows = [(i, " ".join(rng.choices(WORDS["abc"[i % 3]], k=6) + rng.choices(mixed, k=4 + i % 9)), ["one", "two", "three", None, None][i % 5], 1, 1) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    goals = spark.createDataFrame([("one", 0.6, 2), ("two", 0.3, 2), ("three", 0.1, 3)], "source string, target_share double, max_repeats int")
    here, spread = ({r["q"]: r["rate"] for r in mixing.Mix(docs, goals, max_groups=n).rates.selectExpr("array_join(q, ' ') q", "rate").collect()} for n in (50_000, 0))
    assert len(here) > 20 and here == pytest.approx(spread, abs=1e-6)
    here, spread = (sorted(map(tuple, mixing.Mix(docs, goals, max_groups=n).copies().collect())) for n in (50_000, 0))
    assert here and here == spread


def test_rates_are_fitted_to_the_end():
    rng = np.random.default_rng(4)
    p = mixing.hundredths(np.exp(rng.normal(size=(500, 6)) * 3)) / 100
    tokens, caps = np.floor(np.exp(rng.normal(size=500) * 2 + 6)) + 1, np.array([1, 2, 3, 4, 2, 0.0])
    mass = p.T @ tokens
    # 0.3: what can be met is met to the end. 9: too much, so rates lie at their caps wherever more would help.
    for size in (0.3, 9):
        goal = np.array([0.4, 0.3, 0.2, 0.1, 0, 0]) * mass.sum() * size
        rate = mixing.fit_rates(mixing.Fit(goal, caps, mass), p, tokens)
        pull = p @ (p.T @ (rate * tokens) - goal) / goal.sum()
        assert (rate >= 0).all() and (rate <= p @ caps + 1e-8).all()
        inner = (rate > 1e-6) & (rate < p @ caps - 1e-6)
        assert np.abs(pull[inner]).max(initial=0) < 1e-6
        some = p @ caps > 1e-3
        assert (pull[some & (rate >= p @ caps - 1e-6)] < 1e-6).all() and (pull[some & (rate <= 1e-6)] > -1e-6).all()


def test_too_many_targets_are_refused(spark):
    goals = spark.range(mixing.MAX_TARGETS + 1).selectExpr("cast(id as string) source", "0.1D target_share", "1 max_repeats")
    with pytest.raises(ValueError):
        mixing.Mix(spark.createDataFrame([], DOCS), goals)
    names = spark.range(topics.MAX_AREAS + 1).selectExpr("cast(id as string) topic", "'x' name_ru")
    with pytest.raises(ValueError):
        topics.assign(spark.createDataFrame([], "id bigint, text string"), spark.createDataFrame([], "processed_article_id bigint, topic string"), names)


def test_words_beyond_the_vocabulary_share_rows(spark):
    from tidewire.llm import bayes

    counts = spark.createDataFrame([(f"слово{i}", float(100 - i), 1.0) for i in range(40)], "word string, c0 double, c1 double")
    model = bayes.collect_model(counts, 2, max_vocab=10, slots=8)
    assert len(model.vocab) == 10 and model.counts.sum() == pytest.approx(sum(101.0 - i for i in range(40)))
    assert all(model.vocab.get(f"слово{i}") is not None for i in range(40)) and model.vocab.get("слово3") == 3
    assert bayes.collect_model(counts, 2).vocab.get("иное") is None


def test_mix(spark):
    rng = random.Random(6)
    source = lambda i: ["one", " ONE", "two", "Three ", None][i % 5]
    rows = [(i, " ".join(rng.choices(WORDS["abc"[i % 3]], k=20)), source(i), 1, 1) for i in range(600)]
    rows += [(9001, None, "one", 1, 1), (9002, "", "one", 1, 1), (9003, "слово " * 50_000, "other", 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    goals = spark.createDataFrame([("one", 0.5, 1), ("two", 0.3, 2), ("absent", 0.2, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(docs, goals)
    copies = {r["doc_id"]: r for r in mix.copies().collect()}
    assert not {9001, 9002, 9003} & set(copies)
    for i, r in copies.items():
        assert r["copies"] <= (1 if r["source"] == "one" else 2)
        if source(i) is not None:
            assert r["source"] == source(i).strip().lower()
    report = {r["source"]: r for r in mix.report().collect()}
    assert report["absent"]["tokens"] == 0 and not report["absent"]["reached"]
    assert report["one"]["actual_share"] / report["two"]["actual_share"] == pytest.approx(5 / 3, rel=0.15)
    assert mix.records().count() == sum(r["copies"] for r in copies.values())
    assert sorted(map(str, mix.copies().collect())) == sorted(map(str, mixing.Mix(docs, goals).copies().collect()))
    assert mixing.Mix(docs.limit(0), goals).records().count() == 0


def test_token_counts_equal_the_encoder():
    c = mixing.TokenCounter(mixing.tokenizer_path())
    for text in ("Привет, мир! It's 2025.", "", "  \n\n пробелы  ", "😀 эмодзи"):
        assert c.count(text) == len(c.encode(text))
