"""Pair counts against brute force, and repeated lines against brute force and increments."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import pairs as P
from tidewire.llm.lines import RepeatedLines

LINKS = "processed_article_id bigint, entity_id bigint, code bigint, n int"


def brute(rows, least=5, lift=5.0):
    sets = defaultdict(set)
    for r, i in rows:
        if r is not None and i is not None:
            sets[r].add(i)
    n, single, both = len(sets), Counter(), Counter()
    for s in sets.values():
        single.update(s)
        both.update(itertools.combinations(sorted(s), 2))
    return {(a, b): c for (a, b), c in both.items() if c >= least and c * n >= lift * single[a] * single[b]}


def count(spark, rows, **kw):
    df = spark.createDataFrame([(r, i, 7, 1) for r, i in rows], LINKS)
    return {(r["a"], r["b"]): r for r in P.pair_counts(df, "processed_article_id", "entity_id", **kw).collect()}


@pytest.mark.parametrize("big", [0, 1 << 40, -(1 << 40)])
def test_pairs_equal_brute_force(spark, big):
    rng = random.Random(5)
    rows = [(a, big + min(60, int(rng.expovariate(0.06)))) for a in range(400) for _ in range(rng.randrange(1, 7))]
    rows += [(a, big + 100 + k) for a in range(6) for k in range(3)] + rows[:50] + [(None, 1), (1, None)]
    want, got = brute(rows, 3, 2.0), count(spark, rows, min_count=3, min_lift=2.0)
    assert want and {k: r["n_ab"] for k, r in got.items()} == want
    for r in got.values():
        assert r["a"] < r["b"] and r["odds_ratio"] > 1 and abs(r["lift"] - r["n_ab"] * r["n"] / (r["n_a"] * r["n_b"])) < 1e-9


def test_long_records_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    rows = [(a, i) for a in range(5) for i in range(60)] + [(a, 1000 + a) for a in range(5, 400)]
    got = count(spark, rows)
    assert len(got) == 60 * 59 // 2 and {r["n_ab"] for r in got.values()} == {5}


def test_hot_items_are_pruned_without_loss(spark):
    rows = [(a, 1) for a in range(100)] + [(a, 2) for a in range(6)] + [(a, 3) for a in range(6)]
    assert set(count(spark, rows)) == {(2, 3)} == set(brute(rows))


def test_no_rows(spark):
    assert count(spark, []) == {}


def test_run_lengths():
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2, 3], [5], [2, 1]], pa.list_(pa.int64())), pa.array([None, None, None], pa.list_(pa.int64()))], names=["left", "right"])
    out = list(P._runs(iter([batch])))[0]
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == {(1 << 32) | 2: 2, (1 << 32) | 3: 1, (2 << 32) | 3: 1}
    parts = [P._out(np.array([1, 1, 2]), np.array([1, 2, 1])), P._out(np.array([2, 3]), np.array([4, 5]))]
    merged = [x for b in P._merge(iter(parts)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert merged == [(1, 3), (2, 5), (3, 5)]


ARTICLES = "id bigint, source_id int, raw_text string, key string, n int"


def letters(line):
    return "".join(c for c in line.lower() if c.isalpha())


def repeated(rows, least=5, share=0.1):
    docs, seen = defaultdict(set), defaultdict(set)
    for i, s, text in rows:
        if s is not None:
            docs[s].add(i)
            for line in (text or "").split("\n"):
                if letters(line):
                    seen[s, letters(line)].add(i)
    return {(i, n) for i, s, text in rows if s is not None and text for n, line in enumerate(text.split("\n"), 1) if len(seen.get((s, letters(line)), ())) >= max(least, share * len(docs[s]))}


def make(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 1) for i, s, t in rows], ARTICLES)


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(200):
        s = rng.choice([1, 1, 2, 3, None])
        lines = [f"Своя строка {i} {rng.random()}", rng.choice(["© Газета 2020", "(c) ГАЗЕТА, 2021", "Подписка!", "***", ""]), f"Тема {rng.randrange(12)}", "12345"]
        rng.shuffle(lines)
        rows.append((i, s, rng.choice([None, "", *["\n".join(lines)] * 8])))
    rows.append((900, 2, "длинно " * 60_000 + "\nПодписка"))
    return rows


def test_lines_equal_brute_force(spark):
    rows = corpus()
    state = RepeatedLines(spark)
    state.merge(make(spark, [*rows, rows[0]]))  # a row that comes twice counts once
    assert {tuple(r) for r in state.found().distinct().collect()} == repeated(rows)


def test_deltas_equal_one_merge(spark):
    rows = corpus()
    state, seen = RepeatedLines(spark), []
    for low in (0, 30, 110):
        part = [r for r in rows if low <= r[0] < {0: 30, 30: 110, 110: 1000}[low]]
        before = repeated(seen)
        seen += part
        changed = state.merge(make(spark, part))
        assert {tuple(r) for r in state.found().collect()} == repeated(seen)
        affected = {r["id"] for r in state.affected(changed).collect()}
        texts = {i: t for i, _, t in seen}
        kept = lambda hits, i: [n for n in range(1, len((texts[i] or "").split("\n")) + 1) if (i, n) not in hits]
        now = repeated(seen)
        assert {i for i in texts if kept(before, i) != kept(now, i) and i in {r[0] for r in seen if r not in part}} <= affected
    rebuilt = {r["id"]: r["text"] for r in state.rebuild(make(spark, rows)).collect()}
    hits = repeated(rows)
    for i, _, text in rows:
        want = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n"), 1) if (i, n) not in hits)
        assert rebuilt[i] == want


def test_documents_that_come_again(spark):
    rows = corpus()
    path = RepeatedLines(spark).store.root
    RepeatedLines(spark, path).merge(make(spark, [(i, s, "Подписка!\n© Газета 2020") for i, s, _ in rows]))
    for k in range(12):  # more deltas than parts are kept; each time by a new reader of the folder
        changed = RepeatedLines(spark, path).merge(make(spark, rows[k::12]))
    state = RepeatedLines(spark, path)
    assert {tuple(r) for r in state.found().distinct().collect()} == repeated(rows)
    assert len(state.store.parts("counts")) <= 9
    full = {r["id"]: r["text"] for r in state.rebuild(make(spark, rows)).collect()}
    part = {r["id"]: r["text"] for r in state.rebuild(make(spark, rows), changed).collect()}
    assert set(part) <= set(full) and all(full[i] == t for i, t in part.items())


def test_rebuild_without_broadcast(spark, monkeypatch):
    rows = corpus()
    state = RepeatedLines(spark)
    state.merge(make(spark, rows))
    full = sorted(map(str, state.rebuild(make(spark, rows)).collect()))
    monkeypatch.setattr("tidewire.llm.lines.BROADCAST_ROWS", 0)
    assert sorted(map(str, state.rebuild(make(spark, rows)).collect())) == full


def test_no_documents(spark):
    state = RepeatedLines(spark)
    state.merge(make(spark, []))
    assert state.found().count() == 0 and state.rebuild(make(spark, [])).count() == 0
