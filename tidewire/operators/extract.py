"""Entity extraction: a registry of engines run inside mapInPandas, and the pipeline from articles to entities and links.

The model packages of morphological extraction and the services behind language models are not part of this
library: an engine is any function (title, text) -> list of mentions. A deterministic gazetteer engine is built in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.markup import clean_html
from tidewire.functions.text import squeeze, strip_dateline

MENTION = "article_id bigint, original_name string, normalized_name string, entity_type string, start int, importance_score double, context_snippet string, error string"
Engine = Callable[[str, str], Iterable[dict]]
_ENGINES: dict[str, Callable[..., Engine]] = {}


def register(name: str, build: Callable[..., Engine]) -> None:
    _ENGINES[name] = build


def engine(name: str, **options) -> Engine:
    if name not in _ENGINES:
        raise ValueError(f"unknown engine: {name}")
    return _ENGINES[name](**options)


def importance(start: int, title: int, text: int) -> float:
    """1.0 in the title, 0.7 in the first fifth of the text, else 0.3."""
    return 1.0 if start < title else 0.7 if start < title + int(0.2 * text) else 0.3


_SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*")


def gazetteer(names: dict[str, str], most_context: int = 300) -> Engine:
    """Finds given names (name -> type) at word boundaries, longest first."""
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda x: (-len(x), x))) + r")(?!\w)") if names else None

    def run(title: str, text: str) -> Iterator[dict]:
        if pattern is None:
            return
        whole = f"{title}\n{text}" if title else text
        spans = [(m.start(), m.end(), m.group().strip()) for m in _SENTENCE.finditer(whole)]
        for m in pattern.finditer(whole):
            context = next((s for a, b, s in spans if a <= m.start() < b), None)
            yield {
                "original_name": m.group(),
                "normalized_name": m.group(),
                "entity_type": names[m.group()],
                "start": m.start(),
                "importance_score": importance(m.start(), len(title), len(text)),
                "context_snippet": context[:most_context] if context else None,
            }

    return run


register("gazetteer", gazetteer)


def clean_articles(articles: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, title, text): HTML removed, datelines of the source stripped, white space squeezed."""
    rows = articles.select("id", "source_id", clean_html("raw_title").alias("title"), clean_html("raw_text").alias("text"))
    if sources is not None:
        names = sources.select(F.col("id").alias("source_id"), F.concat_ws(" ", "external_id", "name").alias("source"))
        rows = rows.join(names, "source_id", "left")
    else:
        rows = rows.withColumn("source", F.lit(None).cast("string"))
    return rows.select("id", squeeze(F.col("title")).alias("title"), squeeze(strip_dateline(F.col("text"), F.col("source"))).alias("text"))


def extract(cleaned: DataFrame, name: str = "gazetteer", **options) -> DataFrame:
    """Mentions of all articles; an article that fails gives one row with its error, the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = engine(name, **options)  # once per Python worker
        columns = ["article_id", "original_name", "normalized_name", "entity_type", "start", "importance_score", "context_snippet", "error"]
        for pdf in batches:
            out = []
            for i, title, text in zip(pdf["id"], pdf["title"], pdf["text"]):
                try:
                    out += [(i, m["original_name"], m["normalized_name"], m["entity_type"], m["start"], m["importance_score"], m["context_snippet"], None) for m in find(title or "", text or "")]
                except Exception as e:  # noqa: BLE001
                    out.append((i, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=columns).astype({"start": "Int32", "article_id": "int64"}) if out else pd.DataFrame({c: pd.Series(dtype="object") for c in columns}).astype({"start": "Int32", "article_id": "int64"})

    return cleaned.select("id", "title", "text").mapInPandas(run, MENTION)


def run_statistics(cleaned: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: total_articles, processed, failed, total_entities."""
    failed = mentions.filter("error is not null").select("article_id").distinct().agg(F.count("*").alias("failed"))
    n = mentions.filter("error is null").select("article_id", "normalized_name", "entity_type").distinct().agg(F.count("*").alias("total_entities"))
    total = cleaned.agg(F.count("*").alias("total_articles"))
    return total.join(failed).join(n).select("total_articles", (F.col("total_articles") - F.col("failed")).alias("processed"), "failed", "total_entities")
