"""Items that appear together: pair counts, lift and odds ratios.

Method: an external sort of packed 64-bit pair codes. Every record's items give codes ``a << 32 | b``; tasks
sort them in bounded runs and run-length count each run before anything is shuffled; the runs are
partitioned by code and sorted by Spark's external sorter, which spills sorted runs and merges them
multiway; a streaming run-length pass adds up equal codes. Then lift and the odds ratio with the
Haldane-Anscombe correction (0.5 to each cell) follow from the marginals.

Exact pruning before any pair is made: with thresholds ``n_ab >= min_count`` and ``n_ab * n >= min_lift * n_a * n_b``
an item with n_a < min_count has no case, and neither has one with ``min_lift * n_a > n`` since n_ab <= n_b.
This removes rare items and the hot ones that would make the longest records.

Records of more than ``BLOCK`` remaining items are split into blocks of about that many by hash, and each
pair of blocks is its own row, so no task holds or expands a whole long record.

Defined results: null records or items are ignored; a repeated (record, item) counts once; ties need no
rule; empty tables give no rows; other columns are ignored. Item ids may be any 64-bit numbers: they are
packed as they are if all lie in [0, 2^31), else through a dictionary of dense codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import written

BLOCK = 256
RUN = 1 << 20


def _rle(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Run-length counts of sorted codes."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    if weights is None:
        return codes[first], np.diff(np.r_[first, len(codes)])
    return codes[first], np.add.reduceat(weights, first)


def _out(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """left, right (arrays of codes; right null: pairs within left) to sorted, run-length counted runs."""
    buffer: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal held
        codes = np.concatenate(buffer)
        buffer.clear()
        held = 0
        codes.sort()
        return _out(*_rle(codes))

    for batch in batches:
        lefts, rights = batch.column("left"), batch.column("right")
        lv, lo = lefts.values.to_numpy(zero_copy_only=False), lefts.offsets.to_numpy()
        rv, ro = rights.values.to_numpy(zero_copy_only=False), rights.offsets.to_numpy()
        none = rights.is_null().to_numpy(zero_copy_only=False)
        sizes = np.diff(lo)
        # Records of one size at once: their pairs are one fancy index.
        for size in np.unique(sizes[none]):
            if size < 2:
                continue
            at = lo[:-1][none & (sizes == size)]
            i, j = np.triu_indices(size, 1)
            step = max(1, RUN // len(i))
            for k in range(0, len(at), step):
                part = lv[at[k : k + step, None] + np.arange(size)]
                a, b = part[:, i].ravel(), part[:, j].ravel()
                codes = (np.minimum(a, b) << 32) | np.maximum(a, b)
                buffer.append(codes)
                held += len(codes)
                if held >= RUN:
                    yield flush()
        for r in np.flatnonzero(~none):
            a, b = lv[lo[r] : lo[r + 1]], rv[ro[r] : ro[r + 1]]
            x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            buffer.append((np.minimum(x, y) << 32) | np.maximum(x, y))
            held += len(x)
            if held >= RUN:
                yield flush()
    if buffer:
        yield flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal codes of a sorted stream; the last code of a batch waits for the next."""
    code, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c, w = _rle(batch.column("code").to_numpy(), batch.column("n").to_numpy())
        if code is not None:
            if c[0] == code:
                w[0] += n
            else:
                yield _out(np.array([code]), np.array([n]))
        code, n = int(c[-1]), int(w[-1])
        yield _out(c[:-1], w[:-1])
    if code is not None:
        yield _out(np.array([code]), np.array([n]))


def dense_codes(items: DataFrame, col: str) -> DataFrame:
    """(col, code): dense codes from 0 in the order of ``col``, without a single-partition window."""
    ranged = written(items.select(col).distinct().repartitionByRange(col).withColumn("_p", F.spark_partition_id()), "codes")
    per = ranged.groupBy("_p").count()  # one row a partition
    start = per.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_start"))
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(col)) - 1)
    return local.join(F.broadcast(start), "_p").select(col, (F.col("_r") + F.col("_start")).alias("code"))


def pair_counts(rows: DataFrame, record: str, item: str, min_count: int = 5, min_lift: float = 5.0) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n, lift, odds_ratio, log_odds), a < b: the pairs over both thresholds."""
    base = rows.select(F.col(record).alias("r"), F.col(item).cast("long").alias("i")).filter("r is not null and i is not null").distinct()
    base = written(base, "pairs-base")  # distinct once: three readers
    n = base.agg(F.count_distinct("r")).first()[0]
    item_n = base.groupBy("i").agg(F.count("*").alias("n_i"))
    item_n = written(item_n.filter((F.col("n_i") >= min_count) & (min_lift * F.col("n_i") <= n)), "pairs-items")
    low, high = item_n.agg(F.min("i"), F.max("i")).first()
    packed = low is None or (low >= 0 and high < 1 << 31)
    coded = item_n.withColumn("code", F.col("i")) if packed else item_n.join(dense_codes(item_n, "i"), "i")
    kept = base.join(coded.select("i", "code"), "i").select("r", "code")
    # Long records only: their number of blocks. Their count is bounded by rows / BLOCK.
    sizes = kept.groupBy("r").agg(F.count("*").alias("k")).filter(F.col("k") > BLOCK)
    wide = written(sizes.select("r", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "pairs-wide")
    if wide.limit(1).count():
        kept = kept.join(wide, "r", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("code"), "blocks"), F.lit(0)).cast("int"))
    else:
        kept = kept.withColumn("block", F.lit(0))
    groups = kept.groupBy("r", "block").agg(F.collect_list("code").alias("left"))
    nothing = F.lit(None).cast("array<bigint>")
    within = groups.filter(F.size("left") > 1).select("left", nothing.alias("right"))
    if wide.limit(1).count():
        side = groups.join(wide.select("r"), "r", "left_semi")
        other = side.select("r", F.col("block").alias("block2"), F.col("left").alias("right"))
        within = within.unionByName(side.join(other, "r").filter("block < block2").select("left", "right"))
    runs = within.mapInArrow(_runs, "code bigint, n bigint")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge, "code bigint, n bigint")
    often = merged.filter(F.col("n") >= min_count).select(F.shiftright("code", 32).alias("ca"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("cb"), F.col("n").alias("n_ab"))
    side = lambda s: coded.select(F.col("code").alias(f"c{s}"), F.col("i").alias(s), F.col("n_i").alias(f"n_{s}"))
    both = often.join(side("a"), "ca").join(side("b"), "cb").withColumn("n", F.lit(n).cast("long"))
    cases = both.filter(F.col("n_ab") * F.col("n") >= min_lift * F.col("n_a") * F.col("n_b"))
    h = F.lit(0.5)
    odds = (F.col("n_ab") + h) * (F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + h) / ((F.col("n_a") - F.col("n_ab") + h) * (F.col("n_b") - F.col("n_ab") + h))
    swap = F.col("a") > F.col("b")
    return cases.select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        "n_ab",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        "n",
        (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        odds.alias("odds_ratio"),
        F.log(odds).alias("log_odds"),
    )
