"""Reading level of each document.

Method: one smoothed unigram language model per level, trained on the labelled documents; a document gets
the level whose model and prior give its words the highest posterior likelihood. Where no labels are
given, texts are seeded by a readability formula (sentence and word length) and the models are trained on
those seeds.

Training uses the labels of at most ``MAX_LABELLED`` documents, chosen by hash (a documented bound for the
fit); every document is assigned, by all its words. Every word of theirs counts (``bayes``).

Defined results: null or blank texts give no row; a text without known words gets the most frequent level;
ties go to the lower level; several labels of one document count for the smallest; repeated rows give one
row; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.bayes import Model, bounded_sample, collect_model, log_likelihoods, sums_by_text, word_counts, words

LEVELS = (1, 2, 3, 4)
MAX_LABELLED = 60_000
ALPHA = 0.1
_END = re.compile(r"[.!?…]+")


def formula_level(text: str) -> int:
    """A seed level from words per sentence and letters per word (thresholds of school, news, feature, expert)."""
    ws = words(text)
    if not ws:
        return 2
    sentences = max(1, len([x for x in _END.split(text) if x.strip()]))
    score = 0.39 * len(ws) / sentences + 1.6 * sum(map(len, ws)) / len(ws)
    return 1 if score < 11 else 2 if score < 15.5 else 3 if score < 20 else 4


def _formula(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([formula_level(t) for t in b.column(1).to_pylist()], pa.int32())], names=["doc_id", "reading_level"])


def train(documents: DataFrame, labels: DataFrame | None) -> tuple[Model, np.ndarray]:
    """The word counts per level, and the levels' log priors."""
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "text").filter("doc_id is not null and text is not null")
    if labels is None or not labels.limit(1).count():
        labels = docs.mapInArrow(_formula, "doc_id bigint, reading_level int")
    labels = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(reading_level as int) reading_level").filter(F.col("reading_level").isin(*LEVELS))
    labels = bounded_sample(labels.groupBy("doc_id").agg(F.min("reading_level").alias("level")), "doc_id", MAX_LABELLED)
    # At most MAX_LABELLED rows of two numbers.
    rows = docs.join(F.broadcast(labels), "doc_id").select("text", F.array(*[(F.col("level") == n).cast("double") for n in LEVELS]).alias("w"))
    model = collect_model(word_counts(rows, len(LEVELS)), len(LEVELS))
    seen = {r["level"]: r["n"] for r in labels.groupBy("level").agg(F.count("*").alias("n")).collect()}
    prior = np.array([seen.get(n, 0) + 1.0 for n in LEVELS])
    return model, np.log(prior / prior.sum())


def assign(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, reading_level): one row per document with a text."""
    spark = documents.sparkSession
    model, prior = train(documents, labels)
    weights = log_likelihoods(model, ALPHA) if len(model.counts) else np.zeros((0, len(LEVELS)))
    shared = spark.sparkContext.broadcast((model.vocab, weights, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, w, p = shared.value
        for b in batches:
            score, _ = sums_by_text(vocab.get, w, [words(t) for t in b.column(1).to_pylist()])
            level = np.array(LEVELS, np.int32)[(score + p).argmax(1)] if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(level, pa.int32())], names=["doc_id", "reading_level"])

    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "text").filter("doc_id is not null and text is not null and trim(text) <> ''")
    return docs.mapInArrow(run, "doc_id bigint, reading_level int").groupBy("doc_id").agg(F.min("reading_level").alias("reading_level"))


def profile(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(reading_level, documents, share)."""
    n = assign(documents, labels).groupBy("reading_level").agg(F.count("*").alias("documents"))
    total = n.agg(F.sum("documents").alias("total"))  # one row
    return n.join(F.broadcast(total)).select("reading_level", "documents", (F.col("documents") / F.col("total")).alias("share"))
