"""Word counts per class, and scores of texts by word weights: what the classifiers here share.

Counting is a map with in-task sums (a few rows a word leave each task) and one small aggregation. A model has a row
for each of the ``MAX_VOCAB`` most frequent words and ``SLOTS`` rows that the others share by their hash, so every word
counts, whatever the vocabulary: at most (MAX_VOCAB + SLOTS) x classes numbers (8 bytes; 25 MB for ten classes) and
MAX_VOCAB words (about 5 MB) come to the driver and are broadcast. Scoring is a map over Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
MAX_VOCAB = 50_000
#: Rows that words beyond the most frequent share.
SLOTS = 1 << 18
#: Words a task holds before it lets go of its sums.
HELD = 200_000


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Vocabulary:
    """Word to row of the model; None for words the model has never seen."""

    def __init__(self, own: dict[str, int], shared: np.ndarray | None = None):
        self.own = own
        #: Row of each slot, -1 where no word fell into it.
        self.shared = shared

    def __len__(self) -> int:
        return len(self.own)

    def get(self, word: str) -> int | None:
        at = self.own.get(word)
        if at is None and self.shared is not None:
            at = int(self.shared[zlib.crc32(word.encode()) % len(self.shared)])
            return at if at >= 0 else None
        return at


@dataclass
class Model:
    vocab: Vocabulary
    counts: np.ndarray  # words x classes


def _counter(k: int) -> Callable:
    names = ["word", *[f"c{i}" for i in range(k)]]

    def flush(ids: dict[str, int], sums: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), *[pa.array(sums[:n, i]) for i in range(k)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        sums = np.zeros((4096, k))
        for b in batches:
            weights = b.column(1).to_pylist()
            for text, w in zip(b.column(0).to_pylist(), weights):
                at = np.fromiter((ids.setdefault(x, len(ids)) for x in words(text)), np.int64)
                if len(ids) > len(sums):
                    sums = np.vstack([sums, np.zeros((max(len(sums), len(ids) - len(sums)), k))])
                u, n = np.unique(at, return_counts=True)
                sums[u] += n[:, None] * np.asarray(w)
            if len(ids) > HELD:
                yield flush(ids, sums)
                ids, sums = {}, np.zeros((4096, k))
        yield flush(ids, sums)

    return run


def word_counts(rows: DataFrame, k: int) -> DataFrame:
    """(word, c0..): summed class weights per word. ``rows``: (text, w array<double> of length k), no nulls."""
    schema = "word string, " + ", ".join(f"c{i} double" for i in range(k))
    parts = rows.select("text", "w").mapInArrow(_counter(k), schema)
    return parts.groupBy("word").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)])


def collect_model(counts: DataFrame, k: int, max_vocab: int = MAX_VOCAB, slots: int = SLOTS) -> Model:
    """The most frequent words (ties by the word) with rows of their own; all others by hash in shared rows."""
    sums = [f"c{i}" for i in range(k)]
    counts = counts.withColumn("n", sum((F.col(c) for c in sums[1:]), F.col("c0")))
    rows = counts.orderBy(F.desc("n"), "word").limit(max_vocab).collect()
    table = [[r[c] for c in sums] for r in rows]
    shared = None
    if len(rows) == max_vocab:
        last = rows[-1]
        rest = counts.filter((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") > last["word"])))
        found = rest.groupBy(F.pmod(F.crc32("word"), F.lit(slots)).alias("slot")).agg(*[F.sum(c).alias(c) for c in sums]).collect()  # at most ``slots`` rows
        if found:
            shared = np.full(slots, -1, np.int64)
            for r in found:
                shared[r["slot"]] = len(table)
                table.append([r[c] for c in sums])
    return Model(Vocabulary({r["word"]: i for i, r in enumerate(rows)}, shared), np.array(table, float).reshape(len(table), k))


def log_likelihoods(model: Model, alpha: float) -> np.ndarray:
    """Smoothed log p(word | class), words x classes."""
    c = model.counts
    return np.log((c + alpha) / (c.sum(0) + alpha * max(1, len(c))))


def complement_weights(counts: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """Complement naive Bayes: the less a word occurs in all other classes, the more it speaks for this one."""
    comp = counts.sum(1, keepdims=True) - counts + alpha
    w = np.log(comp / comp.sum(0))
    return w.mean(1, keepdims=True) - w


def sums_by_text(get: Callable, weights: np.ndarray, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x classes, known words): summed weights of each text's known words."""
    flat: list[int] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, ts in enumerate(texts):
        flat.extend([x for x in map(get, ts) if x is not None])
        ends[i + 1] = len(flat)
    n = np.diff(ends)
    out = np.zeros((len(texts), weights.shape[1]))
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(weights[np.array(flat, np.int64)], ends[:-1][some], axis=0)
    return out, n


def bounded_sample(labels: DataFrame, key: str, most: int) -> DataFrame:
    """The label rows of at most about ``most`` keys, chosen by a hash of the key; all of them if they are no more."""
    n = labels.select(key).distinct().count()
    if n <= most:
        return labels
    return labels.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * most / n))
