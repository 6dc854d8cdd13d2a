"""The median of everything so far, for every row of a long series.

Rows are cut into blocks of time.  Within a block of so many rows the median of all
before can move by half as many places in their order, no further; so a block needs, of all
earlier values, those of ranks near its starting median, and how many lie below.  Counts of
values by block and by bucket of value tell which buckets these are.  Each block is then
walked on its own, backward, over a linked list in order of value: taking a value out
moves the median by one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.recursive import TICK
from strandline.functions.sliced import row_numbers, stretch

#: Blocks of time, and buckets of value for each: what the driver counts over.
BLOCKS, BUCKETS_A_BLOCK = 256, 2


def walked(old: np.ndarray, new: np.ndarray, before: int, below: int) -> np.ndarray:
    """Medians after each of ``new``, in its order, behind ``before`` earlier values, of which ``below`` lie under
    all of ``old``, the others left out lie above it, and no median of the walk is among those left out."""
    n = len(new)
    order = np.argsort(np.concatenate([old, new]), kind="stable")
    value = np.concatenate([old, new])[order]
    node = np.empty(len(order), dtype=np.int64)
    node[order] = np.arange(len(order))
    taken = node[len(old) :].tolist()
    left, right, v = list(range(-1, len(order) - 1)), list(range(1, len(order) + 1)), value.tolist()
    total = before + n
    at = (total - 1) // 2 - below
    out = np.empty(n)
    for i in range(n - 1, -1, -1):
        low = v[at]
        high = low if total % 2 else v[right[at]]
        out[i] = low if low == high else 0.5 * low + 0.5 * high
        x = taken[i]
        if total % 2:
            if x >= at:
                at = left[at]
        elif x <= at:
            at = right[at]
        a, b = left[x], right[x]
        if a >= 0:
            right[a] = b
        if b < len(v):
            left[b] = a
        total -= 1
    return out


def _ranges(counts: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of each block: (earlier values, those below its buckets); and all (block, bucket) pairs it needs."""
    facts, pairs, so_far = [], [], np.zeros(counts.shape[1], dtype=np.int64)
    for block, own in enumerate(counts):
        m, n = int(so_far.sum()), int(own.sum())
        until = np.cumsum(so_far)
        below = 0
        if m:
            first, last = max(0, (m - n) // 2 - 2), min(m - 1, (m + n) // 2 + 2)
            low, high = (int(np.searchsorted(until, r, "right")) for r in (first, last))
            below = int(until[low - 1]) if low else 0
            pairs += [(block, b) for b in range(low, high + 1) if so_far[b]]
        facts.append((m, below))
        so_far = so_far + own
    return facts, pairs


def _walker(facts: list[tuple[int, int]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        before, below = facts[int(rows["_block"].iloc[0])]
        own = rows[rows["_own"]].sort_values(TICK)
        there = own["_there"].to_numpy(dtype=bool)
        old = rows.loc[~rows["_own"], "_v"].to_numpy(dtype=float)
        medians = walked(old, own["_v"].to_numpy(dtype=float)[there], before, below)
        # A row without a value has the median of those before it.
        start = _median(np.sort(old), before, below) if before else np.array([np.nan])
        so_far = np.cumsum(there)
        return pd.DataFrame({TICK: own[TICK].to_numpy(), "_median": np.concatenate([start, medians])[so_far], "_n": before + so_far})

    return run


def _median(old: np.ndarray, before: int, below: int) -> np.ndarray:
    low, high = old[(before - 1) // 2 - below], old[before // 2 - below]
    return np.array([low if low == high else 0.5 * low + 0.5 * high])


def expanding_median(series: DataFrame, value: str, *, order: str = "session_date", blocks: int = BLOCKS) -> DataFrame:
    """``series`` with _median, the median of ``value`` up to each row in order of ``order``, and _n, how many
    values that is; null where there is none.  Missing values do not count; NaN is the largest.

    The driver holds counts of ``blocks`` times ``BUCKETS_A_BLOCK`` buckets; a task holds one block
    and about one and a half times as many earlier values.
    """
    alone = series.withColumn("ticker", F.lit(0)) if "ticker" not in series.columns else series.withColumns({"_ticker_kept": F.col("ticker"), "ticker": F.lit(0)})
    n = series.count()
    if not n:
        return series.withColumns({"_median": F.lit(None).cast("double"), "_n": F.lit(0).cast("long")})
    size = -(-n // blocks)
    numbered = row_numbers(alone, order=order, time=stretch(alone, size, order=order))
    values = numbered.select(TICK, F.col(value).cast("double").alias("_v"), F.floor(F.col(TICK) / size).cast("int").alias("_block"))
    shares = [(i + 1) / (blocks * BUCKETS_A_BLOCK) for i in range(blocks * BUCKETS_A_BLOCK - 1)]
    bounds = values.agg(F.percentile_approx("_v", shares, 20 * len(shares) + 100)).first()[0] or []
    bounds = np.unique(np.array(bounds, dtype=float))

    def bucket(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, v.to_numpy(dtype=float), "right"))

    placed = values.withColumn("_bucket", F.when(F.col("_v").isNotNull(), F.pandas_udf(bucket, "int")("_v")))
    cells = placed.where("_v is not null").groupBy("_block", "_bucket").count().toArrow().to_pydict()
    counts = np.zeros((-(-n // size), len(bounds) + 1), dtype=np.int64)
    counts[cells["_block"], cells["_bucket"]] = cells["count"]
    facts, pairs = _ranges(counts)
    needs = series.sparkSession.createDataFrame(pairs, "_for int, _bucket int")
    # Blocks times buckets at most: 131,072 pairs of small numbers by default.
    needs = F.broadcast(needs) if len(pairs) <= BLOCKS * BLOCKS * BUCKETS_A_BLOCK else needs
    earlier = placed.join(needs, "_bucket").where(F.col("_block") < F.col("_for"))
    earlier = earlier.select(F.col("_for").alias("_block"), TICK, "_v", F.lit(False).alias("_own"), F.lit(True).alias("_there"))
    own = values.select("_block", TICK, "_v", F.lit(True).alias("_own"), F.col("_v").isNotNull().alias("_there"))
    medians = own.unionByName(earlier).groupBy("_block").applyInPandas(_walker(facts), f"{TICK} long, _median double, _n long")
    out = numbered.join(medians, TICK).drop(TICK, "ticker")
    out = out.withColumn("_median", F.when(F.col("_n") > 0, F.col("_median")))
    return out.withColumnRenamed("_ticker_kept", "ticker").select(*series.columns, "_median", "_n")
