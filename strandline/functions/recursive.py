"""Recursive smoothing y(t) = rho * y(t - 1) + c * x(t) from a seed, in closed form.

A running sum of c * x(i) * rho**-i gives all values in one window pass, but its
scale grows without end.  Rows are therefore cut into blocks, over which rho
falls to about 1e-20 to 1e-200: inside a block the sum stays in range, and of what
came before only the previous block's last value counts, to full precision.

Windows over blocks and over a key's rows by (block, row) need the same order of
rows, so recursions of one block length share one sort, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import BY_TICKER, over

#: Rows of a block wherever rho is in the range that it serves.
BLOCK = 1100

#: The row's number within its key, and the order of a numbered frame.
TICK = "_t"
BY_ROW = ("_b", TICK)


def numbered(frame: DataFrame, keys: tuple[str, ...] = BY_TICKER) -> DataFrame:
    """``frame`` with _t, the row's number within its key from 0, and _b, its block."""
    out = frame.withColumn(TICK, F.row_number().over(over(keys)) - 1)
    return out.withColumn("_b", F.floor(F.col(TICK) / BLOCK).cast("int"))


@dataclass(frozen=True)
class Recursion:
    """``out`` is ``seed`` at row ``start`` of each key, the recursion after it, null before.
    Where ``seed`` is a number n, it is ``scale`` times the mean of the n values up to ``start``."""

    out: str
    x: Column
    rho: float
    c: float
    start: int
    seed: Column | int
    scale: float = 1.0

    def block(self) -> int:
        decay = math.log(1 / self.rho)
        return BLOCK if 40 / BLOCK <= decay <= 460 / BLOCK else max(1, int(230 / decay))


def recursions(frame: DataFrame, steps: Sequence[Recursion], *, at: str = "_t", keys: tuple[str, ...] = BY_TICKER) -> DataFrame:
    """``frame``, whose ``at`` numbers a key's rows from 0 without gaps, with the result of each step.

    Steps do not see each other's results.
    """
    for block in sorted({s.block() for s in steps}):
        mine, t = [s for s in steps if s.block() == block], F.col(at)
        # A numbered frame has its blocks already.
        b = "_b" if block == BLOCK and at == "_t" and "_b" in frame.columns else f"_b{block}"
        if b != "_b":
            frame = frame.withColumn(b, F.floor(t / block).cast("int"))
        rows = Window.partitionBy(*keys).orderBy(b, at)
        inside = Window.partitionBy(*keys, b).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        before = rows.rowsBetween(Window.unboundedPreceding, -1)
        age = (t - F.col(b) * block).cast("double")
        seed = lambda s: F.lit(s.scale) * F.avg(s.x).over(rows.rowsBetween(-(s.seed - 1), 0)) if isinstance(s.seed, int) else s.seed
        frame = frame.withColumns({f"_x_{s.out}": F.when(t == s.start, seed(s)).when(t > s.start, F.lit(s.c) * s.x) for s in mine})
        frame = frame.withColumns({f"_y_{s.out}": F.pow(F.lit(s.rho), age) * F.sum(F.col(f"_x_{s.out}") * F.pow(F.lit(s.rho), -age)).over(inside) for s in mine})
        frame = frame.withColumns({f"_c_{s.out}": F.last(F.when(age == block - 1, F.col(f"_y_{s.out}")), ignorenulls=True).over(before) for s in mine})
        carried = lambda s: F.pow(F.lit(s.rho), age + 1) * F.col(f"_c_{s.out}")
        value = lambda s: F.coalesce(F.col(f"_y_{s.out}") + carried(s), f"_y_{s.out}", carried(s))
        frame = frame.withColumns({s.out: F.when(t >= s.start, value(s)) for s in mine})
        frame = frame.drop(*(f"_{k}_{s.out}" for s in mine for k in "xyc"), *([b] if b != "_b" else []))
    return frame


def smoothed(frame: DataFrame, out: str, x: Column, *, rho: float, c: float, start: int, seed: Column, at: str = "_t", keys: tuple[str, ...] = BY_TICKER) -> DataFrame:
    """One recursion; ``seed`` is read at row ``start`` only."""
    return recursions(frame, [Recursion(out, x, rho, c, start, seed)], at=at, keys=keys)


def ema(out: str, x: Column, n: int, *, start: int | None = None) -> Recursion:
    """Exponential mean of span ``n``, seeded by the plain mean of the ``n`` values up to ``start``."""
    alpha = 2 / (n + 1)
    return Recursion(out, x, 1 - alpha, alpha, n - 1 if start is None else start, n)


def wilder_mean(out: str, x: Column, n: int, *, start: int) -> Recursion:
    """Wilder's mean: weight 1/n, seeded by the plain mean of the ``n`` values up to ``start``."""
    return Recursion(out, x, 1 - 1 / n, 1 / n, start, n)


def wilder_sum(out: str, x: Column, n: int) -> Recursion:
    """Wilder's sum: loses 1/n of itself a row, seeded by the sum of rows 1 to n - 1."""
    return Recursion(out, x, 1 - 1 / n, 1.0, n - 1, n - 1, scale=n - 1.0)
