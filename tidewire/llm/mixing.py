"""Mixing sources to target shares of the total size in tokens.

Method: soft membership. A document belongs to the domain its source names; where the source is missing, a
naive Bayes classifier trained on the table's labelled documents predicts posteriors over the domains (all
other sources are one more domain). Nonnegative document rates, capped by the domains' repeats, are fitted by least
squares so that the expected token totals of the domains match their targets. A document's rate depends on its
membership only, so documents are grouped by their whole posterior (in hundredths that add up to one). Of all rates with
the least misses those nearest to the start are taken: they follow from one price a domain, and Newton steps find
the prices, each step one aggregation over the table of groups, however many there are, until the misses are least.

A document of uncertain source counts as one domain, drawn by its posterior from its hash. Copies are no independent
draws: the documents of a group are ranked by their tokens, and the n-th gets floor(rate n + u) - floor(rate (n - 1) + u)
copies, u between 0 and 1 by the group's hash. So a group's tokens miss its rate by about one document. Ranks come from range partitions and their offsets, so a
source with a third of all rows is no single task.

The classifier is fitted on at most ``MAX_LABELLED`` labelled documents chosen by hash; tokens are counted and copies
assigned for every document. Token counts add up over the pre-tokens of the byte-level BPE, so each task keeps a
bounded cache of pre-token lengths.

The default size is the largest at which every target that has documents is met; with ``total_tokens`` a target that is
too small is used up to its cap, and the report says so.

Defined results: null and empty texts have no tokens and are not used; sources match ignoring case and
outer or odd spacing; repeated rows are separate records; a target whose source has no documents gets 0 and is
reported as not reached; more than ``MAX_TARGETS`` targets are refused; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.llm.bayes import bounded_sample, collect_model, log_likelihoods, sums_by_text, word_counts, words
from tidewire.session import written

MAX_LABELLED = 20_000
CACHE = 300_000
STEPS = 100  # memberships are kept in hundredths
MAX_TARGETS = 1_000
#: Up to so many groups their rates are broadcast to the documents; more are joined. The rates are the same.
MAX_GROUPS = 50_000
#: The weights of nearness to the start beside the misses, each solved from the prices of the one before; only the last counts.
NEARNESS = tuple(10.0**-i for i in range(9))
#: The part of the total size that the last prices may leave open, and the passes after which the fit gives up.
OPEN, MAX_PASSES = 1e-9, 1_000
#: A target is reached if its tokens are within this part of the goal.
REACHED = 0.02


def tokenizer_path() -> str:
    """The default vocabulary file; a parameter of everything here."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


class TokenCounter:
    """Token counts by a public byte-level BPE vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.cache: dict[str, int] = {}

    def count(self, text: str) -> int:
        cache, total = self.cache, 0
        for piece in self.split(text):
            n = cache.get(piece)
            if n is None:
                n = len(self.encode(piece))
                if len(cache) >= CACHE:
                    cache.clear()
                cache[piece] = n
            total += n
        return total


def source_key(source):
    return F.trim(F.regexp_replace(F.lower(source), r"(?U)\s+", " "))


def hundredths(q: np.ndarray) -> np.ndarray:
    """Rows of posteriors as whole hundredths that add up to 100: the largest remainders are rounded up, ties at the first."""
    share = q / q.sum(1, keepdims=True) * STEPS
    whole = np.floor(share + 1e-9)
    rank = np.argsort(np.argsort(whole - share, axis=1, kind="stable"), axis=1, kind="stable")
    return (whole + (rank < (STEPS - whole.sum(1, keepdims=True)))).astype(np.int32)


def memberships(documents: DataFrame, targets: list[str], path: str | None = None) -> DataFrame:
    """(doc_id, q, n_tokens): each document's hundredths per domain (an index into ``targets``; the last is any other
    source); a known source has all hundred."""
    spark = documents.sparkSession
    path = path or tokenizer_path()
    k = len(targets) + 1
    index = F.create_map(*[F.lit(x) for i, t in enumerate(targets) for x in (t, i)]) if targets else None
    key = source_key(F.col("source"))
    domain = F.when(key.isNull() | (key == ""), None).otherwise(F.coalesce(F.try_element_at(index, key), F.lit(k - 1)) if targets else F.lit(k - 1))
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "text", "source").filter("doc_id is not null and text is not null and text <> ''")
    docs = docs.select("doc_id", "text", domain.cast("int").alias("domain"))
    seen = bounded_sample(docs.filter("domain is not null"), "doc_id", MAX_LABELLED)
    rows = seen.select("text", F.array(*[(F.col("domain") == i).cast("double") for i in range(k)]).alias("w"))
    model = collect_model(word_counts(rows, k), k)
    sizes = {r["domain"]: r["count"] for r in docs.filter("domain is not null").groupBy("domain").count().collect()}
    prior = np.log(np.array([sizes.get(i, 0) + 0.5 for i in range(k)]))
    like = log_likelihoods(model, 1.0) if len(model.counts) else np.zeros((0, k))
    shared = spark.sparkContext.broadcast((model.vocab, like - like.mean(1, keepdims=True) if len(like) else like, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        vocab, w, p = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            domain = b.column(2).to_pylist()
            n = [counter.count(t) for t in texts]
            q = np.zeros((len(texts), k), np.int32)
            sure = [i for i, d in enumerate(domain) if d is not None]
            q[sure, [domain[i] for i in sure]] = STEPS
            loose = [i for i, d in enumerate(domain) if d is None]
            if loose:
                score, known = sums_by_text(vocab.get, w, [words(texts[i]) for i in loose])
                # Words of one text repeat each other: the evidence grows with the root of their number.
                score = score / np.sqrt(np.maximum(known, 1))[:, None] + p
                q[loose] = hundredths(np.exp(score - score.max(1, keepdims=True)))
            ends = pa.array(np.arange(len(texts) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(q.ravel(), pa.int32())), pa.array(n, pa.int64())], names=["doc_id", "q", "n_tokens"])

    return docs.mapInArrow(run, "doc_id bigint, q array<int>, n_tokens bigint")


class Fit:
    """Least squares on the misses of the domains' expected token totals; 0 <= rate <= expected cap. A group's rate is its start
    less the prices of its domains in its own measure; the dual of the least squares has these prices as its only unknowns."""

    def __init__(self, goal: np.ndarray, caps: np.ndarray, mass: np.ndarray):
        self.goal, self.caps, self.mass, self.total = goal, caps, mass, max(goal.sum(), 1.0)

    def _at(self, p: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cap = p @ self.caps
        measure = 0.5 * self.total / np.maximum(p @ self.mass, 1.0)
        return np.minimum(cap, 1.0) - measure * (p @ prices), cap, measure

    def rates(self, p: np.ndarray, prices: np.ndarray) -> np.ndarray:
        free, cap, _ = self._at(p, prices)
        return np.round(np.clip(free, 0.0, cap), 9)

    def sums(self, p: np.ndarray, tokens: np.ndarray, prices: np.ndarray) -> np.ndarray:
        """The domains' totals, then what they change by with the prices (domains x domains), both of these groups only."""
        free, cap, measure = self._at(p, prices)
        bend = p * np.where((free >= 0) & (free <= cap), tokens * measure, 0.0)[:, None]
        return np.concatenate([p.T @ (np.clip(free, 0.0, cap) * tokens), (bend.T @ p).ravel()])

    def miss(self, totals: np.ndarray) -> np.ndarray:
        return (totals - self.goal) / self.total

    def prices(self, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The prices, from ``sums`` over all groups at given prices: Newton steps, shortened where they lead uphill."""
        k, passes = len(self.goal), 0

        def at(x: np.ndarray) -> np.ndarray:
            nonlocal passes
            if (passes := passes + 1) > MAX_PASSES:
                raise RuntimeError(f"mixing: the fit is still open after {MAX_PASSES} passes")
            return sums(x)

        x = np.zeros(k)
        got = at(x)
        scale = max(1.0, np.abs(self.miss(got[:k])).max(initial=0.0))
        for near in NEARNESS:
            least = scale * (OPEN if near == NEARNESS[-1] else 0.01 * near**0.5)
            while np.abs(slope := near * x - self.miss(got[:k])).max(initial=0.0) > least:
                step, part = -np.linalg.solve(got[k:].reshape(k, k) / self.total + near * np.eye(k), slope), 1.0
                down = -(slope @ step)
                while True:
                    new = x + part * step
                    got = at(new)
                    up = (near * new - self.miss(got[:k])) @ step
                    if up <= 0.5 * down:
                        break
                    part *= max(0.1, down / (down + up))
                x = new
        return x


def fit_rates(fit: Fit, p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The rates of the membership groups ``p`` (groups x domains) of so many tokens."""
    return fit.rates(p, fit.prices(lambda x: fit.sums(p, tokens, x)))


def _matrix(q: pa.Array, k: int) -> np.ndarray:
    return q.flatten().to_numpy(zero_copy_only=False).reshape(len(q), k) / STEPS


def spread_rates(fit: Fit, groups: DataFrame) -> DataFrame:
    """(q, rate) of (q, tokens): ``fit_rates`` over a table, each pass one aggregation."""
    k = len(fit.goal)

    def sums(prices: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + k * k)
            for b in batches:
                out += fit.sums(_matrix(b.column(0), k), b.column(1).to_numpy(zero_copy_only=False), prices)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(out[at])], names=["at", "x"])

        got = groups.select("q", "tokens").mapInArrow(part, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(k + k * k)
        out[got.column("at").to_numpy()] = got.column("x").to_numpy()
        return out

    prices = fit.prices(sums)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fit.rates(_matrix(b.column(0), k), prices))], names=["q", "rate"])

    return groups.select("q", "tokens").mapInArrow(rates, "q array<int>, rate double")


class Mix:
    """A fitted mixture over documents."""

    def __init__(self, documents: DataFrame, mix_targets: DataFrame, total_tokens: float | None = None, path: str | None = None, max_groups: int = MAX_GROUPS):
        rows = mix_targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("double").alias("cap"))
        rows = rows.filter("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).orderBy("source").limit(MAX_TARGETS + 1).collect()
        if len(rows) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} targets")
        self.spark = documents.sparkSession
        self.targets = [r["source"] for r in rows]
        self.shares = np.array([r["share"] or 0.0 for r in rows] + [0.0])
        self.caps = np.floor(np.array([r["cap"] or 0.0 for r in rows] + [0.0]))
        k = len(self.targets) + 1
        self.members = written(memberships(documents, self.targets, path), "members")
        groups = written(self.members.groupBy("q").agg(F.sum("n_tokens").cast("double").alias("tokens")), "groups")
        sums = groups.agg(F.count("*").alias("n"), *[F.sum(F.col("q")[i] * F.col("tokens") / STEPS).alias(f"t{i}") for i in range(k)]).first()
        mass = np.array([sums[f"t{i}"] or 0.0 for i in range(k)])
        own = mass[:-1]
        some = (self.shares[:-1] > 0) & (own > 0)
        exact = (self.caps[:-1][some] * own[some] / self.shares[:-1][some]).min(initial=own.sum())
        self.total = float(exact if total_tokens is None else total_tokens)
        fit = Fit(self.shares * self.total, self.caps, mass)
        rates = written(spread_rates(fit, groups), "rates")
        self.rates = F.broadcast(rates) if sums["n"] <= max_groups else rates

    def copies(self) -> DataFrame:
        """(doc_id, source, n_tokens, copies): every document in the mix and how often."""
        rows = self.members.join(self.rates, "q").filter("rate > 1e-9").withColumn("h", F.xxhash64(F.lit("mix"), "doc_id"))
        order = ["q", "n_tokens", "h", "doc_id"]
        ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
        per = ranged.groupBy("part", "q").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("q").orderBy("part")) - F.col("n")  # a row a group and partition
        local = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part", "q").orderBy("n_tokens", "h", "doc_id")))
        ranked = local.join(per.select("part", "q", before.alias("start")), ["part", "q"]).withColumn("at", F.col("at") + F.col("start"))
        offset = F.pmod(F.xxhash64(F.lit("offset"), "q"), F.lit(1_000_000)) / 1_000_000 + 1e-9
        n = F.floor(F.col("rate") * F.col("at") + offset) - F.floor(F.col("rate") * (F.col("at") - 1) + offset)
        draw = F.pmod(F.xxhash64(F.lit("domain"), "doc_id"), F.lit(1_000_000)) / 1_000_000 * STEPS
        reach = F.transform("q", lambda x, i: F.aggregate(F.slice("q", 1, i + 1), F.lit(0), lambda s, y: s + y))
        domain = F.size(F.filter(reach, lambda x: x <= draw))
        names = F.array(*[F.lit(t) for t in self.targets], F.lit(None).cast("string"))
        caps = F.array(*[F.lit(int(c)) for c in self.caps])
        out = ranked.withColumn("domain", domain).select("doc_id", F.get(names, "domain").alias("source"), "n_tokens", F.least(n, F.get(caps, "domain")).cast("int").alias("copies"))
        return out.filter("copies > 0 and source is not null")

    def records(self) -> DataFrame:
        """(doc_id, copy, source, n_tokens): the mixed records, one row a copy."""
        return self.copies().select("doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "source", "n_tokens")

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, goal, tokens, documents, copies, error, reached): the shares of the mixed records,
        and by what part of its goal in tokens each source lies above or below it."""
        per = self.copies().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
        goals = self.spark.createDataFrame([(t, float(s), float(s) * self.total) for t, s in zip(self.targets, self.shares)], "source string, target_share double, goal double")
        total = per.agg(F.sum("tokens").alias("total"))
        out = goals.join(per, "source", "left").join(F.broadcast(total))  # one row
        share = F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        error = F.when(F.col("goal") > 0, F.coalesce(F.col("tokens"), F.lit(0)) / F.col("goal") - 1)
        out = out.select("source", "target_share", share.alias("actual_share"), "goal", zero("tokens"), zero("documents"), zero("copies"), error.alias("error"))
        return out.withColumn("reached", F.coalesce(F.abs("error") <= REACHED, F.lit(False)))
