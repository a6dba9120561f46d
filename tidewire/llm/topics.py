"""Subject areas of each document.

Method: complement naive Bayes over sentences. The labelled documents' sentences train the first model (a
sentence may belong to any of its document's labelled areas); expectation-maximization then refines it over
all documents: every sentence gets posteriors (labelled documents' within their labels), whose weighted word counts
are the next model. A document's share of an area is the part of its words in sentences of that area; shares
are turned into independent posteriors per area by a logistic curve fitted on the labelled documents, and
an area is assigned at a posterior of one half or more. Every document keeps at least its largest area.

Fit on at most ``MAX_LABELLED`` labelled documents, chosen by hash; the EM rounds read every document. Each round is one
map with in-task sums: what is shuffled is words x areas per task, so a round has a few tasks per core of the cluster
(``TASKS_PER_CORE``) and not one per file; a task streams its part, whatever its size. Texts are split and coded into word numbers once, in a written table the rounds stream.

Defined results: null or blank texts give no row; a text without a word of the labelled ones
gets the most frequent area; ties go
to the first area by name; unknown areas in labels are ignored; repeated rows give one row; empty tables give none;
without labels there is no result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.bayes import Model, bounded_sample, collect_model, complement_weights, word_counts, words
from tidewire.session import written

MAX_LABELLED = 50_000
EM_ROUNDS = 2
TASKS_PER_CORE = 4
ALPHA = 0.5
#: More areas are refused: the model holds a number per word and area.
MAX_AREAS = 1000
SENTENCE = re.compile(r"(?<=[.!?…])[»\")\]]*\s+|\n+")


_READABLE = "id is not null and text is not null and trim(text) <> ''"


CODED = "id bigint, w array<double>, sentences array<array<int>>"


def _coder(shared):
    """(id, w, text) to (id, w, sentences as word numbers): each text is split once, whatever the rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            flat: list[int] = []
            ends, outer = [0], [0]
            for text in b.column(2).to_pylist():
                for s in SENTENCE.split(text):
                    flat.extend([x for x in map(get, words(s)) if x is not None])
                    if len(flat) > ends[-1]:
                        ends.append(len(flat))
                outer.append(len(ends) - 1)
            inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            coded = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), coded], names=["id", "w", "sentences"])

    return run


def _posteriors(coded: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of a batch of coded texts: word numbers, words in each, number of the document, posteriors."""
    per_doc = coded.value_lengths().to_numpy(zero_copy_only=False)
    inner = coded.flatten()
    n = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(per_doc)), per_doc.astype(np.int64))
    if not len(n):
        return flat, n, owner, np.zeros((0, weights.shape[1]))
    score = np.add.reduceat(weights[flat], np.r_[0, np.cumsum(n)[:-1]], axis=0)  # no sentence is empty
    score -= score.max(1, keepdims=True)
    q = np.exp(score)
    return flat, n, owner, q / q.sum(1, keepdims=True)


def _shares(flat: np.ndarray, n: np.ndarray, owner: np.ndarray, q: np.ndarray, docs: int, labelled: np.ndarray) -> np.ndarray:
    """Per document its areas' shares; none without a word of the labelled documents."""
    out = np.stack([np.bincount(owner, weights=q[:, j] * n, minlength=docs) for j in range(q.shape[1])], 1)
    some = np.bincount(np.repeat(owner, n), weights=labelled[flat], minlength=docs) > 0
    return out / np.maximum(out.sum(1, keepdims=True), 1e-300) * some[:, None]


def _em_round(coded: DataFrame, model: Model, k: int) -> Model:
    """One round over all documents: posteriors by the model, word counts weighted by them."""
    shared = coded.sparkSession.sparkContext.broadcast(complement_weights(model.counts, ALPHA))
    size = len(model.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        sums = np.zeros((size, k))
        for b in batches:
            flat, n, owner, q = _posteriors(b.column(1), w)
            mask = np.array([a if a is not None else [1.0] * k for a in b.column(0).to_pylist()]).reshape(b.num_rows, k)
            q = q * mask[owner]
            q /= np.maximum(q.sum(1, keepdims=True), 1e-300)
            each = np.repeat(np.arange(len(n)), n)
            for j in range(k):
                sums[:, j] += np.bincount(flat, weights=q[each, j], minlength=size)
        some = np.flatnonzero(sums.sum(1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(sums[some, j]) for j in range(k)]], names=["word", *[f"c{j}" for j in range(k)]])

    schema = "word bigint, " + ", ".join(f"c{j} double" for j in range(k))
    tasks = coded.select("w", "sentences").coalesce(max(8, TASKS_PER_CORE * coded.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema).groupBy("word").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)])
    counts = np.zeros((size, k))
    for r in tasks.collect():  # a row of the model each
        counts[r["word"]] = [r[f"c{j}"] for j in range(k)]
    return Model(model.vocab, counts)


def _calibrate(share: np.ndarray, is_label: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> tuple[float, float]:
    """Slope and offset of the logistic curve from share to posterior (Newton steps, lightly regularised)."""
    a, b = 20.0, -5.0
    x, y = share.ravel(), is_label.ravel().astype(float)
    if not len(x) or y.min() == y.max():
        return a, b
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).mean() + ridge * (a - 20.0) / 400, (p - y).mean() + ridge * (b + 5.0) / 25])
        h = np.array([[(v * x * x).mean() + ridge / 400, (v * x).mean()], [(v * x).mean(), v.mean() + ridge / 25]])
        da, db = np.linalg.solve(h, g)
        size = max(1.0, abs(da) / 10, abs(db) / 4)
        a, b = a - da / size, b - db / size
    return float(a), float(b)


class Topics:
    """A fitted classifier."""

    def __init__(self, articles: DataFrame, labels: DataFrame, names: list[str], rounds: int = EM_ROUNDS):
        self.names, k = sorted(names), len(names)
        self.spark = spark = articles.sparkSession
        base = articles.selectExpr("cast(id as bigint) id", "text").filter(_READABLE)
        own = labels.selectExpr("cast(processed_article_id as bigint) id", "topic").filter(F.col("topic").isin(*self.names) & F.col("id").isNotNull())
        own = bounded_sample(own, "id", MAX_LABELLED).groupBy("id").agg(F.collect_set("topic").alias("topics"))
        allowed = own.select("id", F.array(*[F.array_contains("topics", t).cast("double") for t in self.names]).alias("w"))
        # At most MAX_LABELLED rows of an id and k numbers.
        rows = base.join(F.broadcast(allowed), "id", "left")
        total = F.aggregate("w", F.lit(0.0), lambda s, y: s + y)
        # One count: the labelled documents' weights per area, and every word once more in the last column.
        even = F.when(F.col("w").isNull(), F.array(*[F.lit(0.0)] * k)).otherwise(F.transform("w", lambda x: x / total))
        every = collect_model(word_counts(rows.select("text", F.concat(even, F.array(F.lit(1.0))).alias("w")), k + 1), k + 1)
        self.model = Model(every.vocab, every.counts[:, :k])
        self.trained = bool(self.model.counts.sum() > 0)
        self.words = spark.sparkContext.broadcast(every.vocab)
        self.coded = written(rows.select("id", "w", "text").mapInArrow(_coder(self.words), CODED), "coded") if self.trained else None
        for _ in range(rounds if self.trained else 0):
            self.model = _em_round(self.coded, self.model, k)
        self.weights = spark.sparkContext.broadcast((complement_weights(self.model.counts, ALPHA), every.counts[:, :k].sum(1) > 0))
        self.slope, self.offset, self.usual = 20.0, -5.0, 0
        if self.trained:
            seen = self.coded.filter("w is not null").mapInArrow(self._share_map(), "w array<double>, share array<double>").toPandas()  # at most MAX_LABELLED rows
            self.slope, self.offset = _calibrate(np.stack(seen["share"].to_numpy()), np.stack(seen["w"].to_numpy()) > 0)
            self.usual = int(np.stack(seen["w"].to_numpy()).sum(0).argmax())

    def _share_map(self):
        shared = self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                weights, labelled = shared.value
                share = _shares(*_posteriors(b.column(2), weights), b.num_rows, labelled)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(share.tolist(), pa.list_(pa.float64()))], names=["w", "share"])

        return run

    def posteriors(self, articles: DataFrame | None = None) -> DataFrame:
        """(processed_article_id, topic, share, posterior): the assigned areas of the documents fitted on, or of others."""
        schema = "processed_article_id bigint, topic string, share double, posterior double"
        if not self.trained:
            return self.spark.createDataFrame([], schema)
        coded = self.coded
        if articles is not None:
            rows = articles.selectExpr("cast(id as bigint) id", "cast(null as array<double>) w", "text").filter(_READABLE)
            coded = rows.mapInArrow(_coder(self.words), CODED)
        shared, names, slope, offset, usual = self.weights, self.names, self.slope, self.offset, self.usual

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                weights, labelled = shared.value
                share = _shares(*_posteriors(b.column(1), weights), b.num_rows, labelled)
                p = 1 / (1 + np.exp(-np.clip(slope * share + offset, -35, 35)))
                yes = p >= 0.5
                top = np.where(share.max(1) > 0, share.argmax(1), usual) if b.num_rows else np.zeros(0, int)
                yes[np.arange(b.num_rows), top] = True
                i, j = np.nonzero(yes)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(i)), pa.array([names[x] for x in j], pa.string()), pa.array(share[i, j]), pa.array(p[i, j])],
                    names=["processed_article_id", "topic", "share", "posterior"],
                )

        return coded.select("id", "sentences").mapInArrow(run, schema)


def assign(articles: DataFrame, labels: DataFrame, topic_names: DataFrame) -> Topics:
    """Fits on the tables; the list of areas is a small fixed table."""
    names = [r[0] for r in topic_names.select("topic").filter("topic is not null").distinct().limit(MAX_AREAS + 1).collect()]
    if len(names) > MAX_AREAS:
        raise ValueError(f"more than {MAX_AREAS} subject areas")
    return Topics(articles, labels, names)
