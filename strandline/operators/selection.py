"""Exact quantiles of groups of any size, by radix selection.

A double's bits, with the sign folded, are whole numbers in the same order.  A pass counts,
for every group, feature and rank that is still open, how its values continue the digits known so far;
the counts tell the next digit.  After all digits the value itself is known.  Memory and
what moves depend on groups, features and ranks, not on rows: tasks send counts alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a digit: six passes over the rows, and 2,048 counters an open path in each task.
DIGIT = 11

#: Groups up to which their numbers are sent to all executors; beyond it rows are exchanged.
BROADCAST_GROUPS = 50_000


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; NaN is the largest, and both zeros are one."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


@dataclass
class Paths:
    """The known leading digits of the ranks of one feature: (group, prefix) pairs, numbered."""

    prefixes: np.ndarray
    number: np.ndarray  # of group x place of the prefix, -1 where no rank goes there
    pairs: list[tuple[int, int]] = field(default_factory=list)

    @staticmethod
    def of(pairs: set[tuple[int, int]], groups: int) -> Paths:
        prefixes = np.array(sorted({p for _, p in pairs}), dtype=np.uint64)
        place = {int(p): i for i, p in enumerate(prefixes)}
        number, order = np.full((groups, len(prefixes)), -1), sorted(pairs)
        for i, (g, p) in enumerate(order):
            number[g, place[p]] = i
        return Paths(prefixes, number, order)


def _counter(paths: Sequence[Paths], known: int, digit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the next ``digit`` bits behind ``known`` ones, a row each that is not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(p.pairs) << digit, dtype=np.int64) for p in paths]
        for batch in batches:
            group = batch.column(0).to_numpy()
            for i, (path, count) in enumerate(zip(paths, counts, strict=True)):
                column = batch.column(i + 1)
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                if not len(there) or not len(path.pairs):
                    continue
                key, of = ordered_bits(column.to_numpy(zero_copy_only=False)[there].astype(np.float64)), group[there]
                prefix = key >> np.uint64(64 - known) if known else np.zeros_like(key)
                place = np.minimum(np.searchsorted(path.prefixes, prefix), len(path.prefixes) - 1)
                at = np.where(path.prefixes[place] == prefix, path.number[of, place], -1)
                code = (at << digit) + (key >> np.uint64(64 - known - digit) & np.uint64((1 << digit) - 1)).astype(np.int64)
                count += np.bincount(code[at >= 0], minlength=len(count))
        for i, (count, path) in enumerate(zip(counts, paths, strict=True)):
            found = np.flatnonzero(count)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, dtype=np.int32)), pa.array(found >> digit), pa.array(found & ((1 << digit) - 1)), pa.array(count[found])], names=["feature", "path", "digit", "n"])

    return run


def _interpolated(position: float, at: Callable[[int], float]) -> float:
    """The value between its two neighbours in rank, in the form that ``percentile`` has."""
    low, high = int(np.floor(position)), int(np.ceil(position))
    a, b = at(low), at(high)
    return a if low == high or a == b else (high - position) * a + (position - low) * b


def exact_quantiles(rows: DataFrame, features: Sequence[str], probabilities: Sequence[float], *, keys: Sequence[str] = ("fold_id",)) -> list[tuple[tuple, dict[str, list[float] | None]]]:
    """For each group, in any order, its key and each feature's quantiles, as ``percentile`` has them (None
    where it has no value).  Nulls do not count, NaN is the largest.

    Groups and ranks live on the driver: folds and features, not rows.  Rows are kept, narrow, while the passes last.
    """
    groups = [tuple(r) for r in rows.select(*keys).distinct().collect()]
    if not groups:
        return []
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    numbered = rows.sparkSession.createDataFrame([(*g, i) for i, g in enumerate(groups)], ", ".join(f"`_k{i}` {kind}" for i, kind in enumerate(kinds)) + ", _g int")
    if len(groups) <= BROADCAST_GROUPS:
        numbered = F.broadcast(numbered)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    narrow = rows.join(numbered, same).select("_g", *(F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Of each group and feature: its ranks as (rank within the prefix, prefix), known after the first pass.
        ranks: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        totals: dict[tuple[int, int], int] = {}
        known = 0
        while known < 64:
            digit = min(DIGIT, 64 - known)
            open_pairs = [{(g, 0) for g in range(len(groups))} if not known else {(g, p) for (i, g), of in ranks.items() if i == f for _, p in of.values()} for f in range(len(features))]
            paths = [Paths.of(pairs, len(groups)) for pairs in open_pairs]
            counted = narrow.mapInArrow(_counter(paths, known, digit), "feature int, path long, digit long, n long").groupBy("feature", "path", "digit").agg(F.sum("n").alias("n")).toArrow().to_pydict()
            counts = [np.zeros((len(p.pairs), 1 << digit), dtype=np.int64) for p in paths]
            for f, p, d, n in zip(*(counted[c] for c in ("feature", "path", "digit", "n")), strict=True):
                counts[f][p, d] = n
            if not known:
                totals = {(f, g): int(counts[f][i].sum()) for f, p in enumerate(paths) for i, (g, _) in enumerate(p.pairs)}
                wanted = lambda n: {r for q in probabilities for r in (int(np.floor(q * (n - 1))), int(np.ceil(q * (n - 1))))}
                ranks = {at: {r: (r, 0) for r in wanted(n)} for at, n in totals.items() if n}
            until = [np.cumsum(c, axis=1) for c in counts]
            place = [{pair: i for i, pair in enumerate(p.pairs)} for p in paths]
            for (f, g), of in ranks.items():
                for r, (left, prefix) in of.items():
                    row = until[f][place[f][g, prefix]]
                    d = int(np.searchsorted(row, left, "right"))
                    of[r] = (left - (int(row[d - 1]) if d else 0), prefix << digit | d)
            known += digit
    finally:
        narrow.unpersist()
    out = []
    for g, key in enumerate(groups):
        found: dict[str, list[float] | None] = {}
        for f, name in enumerate(features):
            of = {r: from_bits(p) for r, (_, p) in ranks.get((f, g), {}).items()}
            found[name] = [_interpolated(q * (totals[f, g] - 1), of.__getitem__) for q in probabilities] if of else None
        out.append((key, found))
    return out
