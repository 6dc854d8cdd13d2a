"""Rolling moments, slopes and extremes whose cost does not grow with the window.

A sliding frame is computed again for every row, so a window of 200 costs 200 steps a row.
Here rows are cut into blocks as long as the window.  A window then is the end of one
block and the beginning of the next: an aggregate that runs backward through the
first, met by one that runs forward through the second.  Both are running ones, a step a row.
The two parts are put together by the rules for merging means, squares and products about
the mean, so nothing is ever subtracted, and no value outside a window touches it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.recursive import TICK, numbered
from strandline.functions.windows import BY_DAY, BY_TICKER, full, last_rows, rolling

#: Windows from this length on go by blocks; two more sorts cost less than their steps.
SHORT = 40

KINDS = ("avg", "stddev_samp", "stddev_pop", "min", "max", "slope")


@dataclass(frozen=True)
class Rolling:
    """``out`` is ``kind`` of the last ``n`` values, null where fewer than ``n`` rows have one.
    ``slope`` is the least-squares slope against the row's number."""

    out: str
    kind: str
    value: Column
    n: int

    def parts(self, spec) -> dict[str, Column]:
        """What of a block's part is needed to merge it."""
        n = F.count(self.value).over(spec)
        if self.kind in ("min", "max"):
            return {"n": n, "m": getattr(F, self.kind)(self.value).over(spec)}
        found = {"n": n, "m": F.avg(self.value).over(spec)}
        if self.kind in ("stddev_samp", "stddev_pop"):
            found["q"] = F.var_pop(self.value).over(spec) * n
        elif self.kind == "slope":
            found["q"] = F.covar_pop(self.value, F.col(TICK).cast("double")).over(spec) * n
        return found

    def merged(self, a: dict[str, Column], b: dict[str, Column]) -> Column:
        """The whole window's value from its two parts."""
        if self.kind in ("min", "max"):
            return (F.least if self.kind == "min" else F.greatest)(a["m"], b["m"])
        both = a["n"] * b["n"] / self.n
        if self.kind == "avg":
            return a["m"] + (b["m"] - a["m"]) * b["n"] / self.n
        if self.kind == "slope":
            # The parts' mean row numbers lie half a window apart.
            return self.whole({"q": a["q"] + b["q"] + (b["m"] - a["m"]) * (self.n / 2) * both})
        return self.whole({"q": a["q"] + b["q"] + (b["m"] - a["m"]) * (b["m"] - a["m"]) * both})

    def whole(self, part: dict[str, Column]) -> Column:
        """The value where the window is one part."""
        if self.kind == "slope":
            return part["q"] / (self.n * (self.n**2 - 1) / 12)
        if self.kind in ("stddev_samp", "stddev_pop"):
            return F.sqrt(part["q"] / (self.n - (self.kind == "stddev_samp")))
        return part["m"]


def rolled(frame: DataFrame, asked: Sequence[Rolling], *, keys: tuple[str, ...] = BY_TICKER, order: tuple[str, ...] = BY_DAY, short: int = SHORT) -> DataFrame:
    """``frame`` with every column asked for; they do not see each other.

    ``order`` is the order of rows within ``keys``.  A frame that has no row numbers gets them for as long as needed.
    """
    if wrong := sorted({a.kind for a in asked} - set(KINDS)):
        raise ValueError(f"unknown kinds {wrong}")
    long = [a for a in asked if a.n >= short]
    bare = TICK not in frame.columns and (long or any(a.kind == "slope" for a in asked))
    if bare:
        frame = numbered(frame, keys)
    slide = lambda a: full(a.value, F.regr_slope(a.value, F.col(TICK).cast("double")).over(last_rows(a.n, keys, order)), a.n, last_rows(a.n, keys, order)) if a.kind == "slope" else rolling(a.kind, a.value, a.n, keys, order)
    frame = frame.withColumns({a.out: slide(a) for a in asked if a.n < short}) if len(long) < len(asked) else frame
    by, t = [F.col(k) for k in keys] or [F.lit(0)], F.col(TICK)
    for n in sorted({a.n for a in long}):
        mine, b = {f"_r{i}_": a for i, a in enumerate(long) if a.n == n}, f"_w{n}"
        frame = frame.withColumn(b, F.floor(t / n).cast("int"))
        ahead = Window.partitionBy(*by, b).orderBy(F.desc(TICK)).rowsBetween(Window.unboundedPreceding, 0)
        so_far = Window.partitionBy(*by, b).orderBy(TICK).rowsBetween(Window.unboundedPreceding, 0)
        # Blocks in order, rows in order: the same order of rows as within blocks, so one sort serves both.
        before = Window.partitionBy(*by).orderBy(b, TICK)
        ends = {f"{p}a{k}": c for p, a in mine.items() for k, c in a.parts(ahead).items()}
        frame = frame.withColumns(ends).withColumns({f"{p}b{k}": c for p, a in mine.items() for k, c in a.parts(so_far).items()})
        frame = frame.withColumns({c: F.lag(c, n - 1).over(before) for c in ends})
        alone = (t + 1) % n == 0  # the window is the block
        value = {}
        for p, a in mine.items():
            first, second = ({k: F.col(f"{p}{side}{k}") for k in a.parts(so_far)} for side in "ab")
            value[a.out] = F.when(alone, F.when(second["n"] == n, a.whole(second))).when(first["n"] + second["n"] == n, a.merged(first, second))
        frame = frame.withColumns(value).drop(b, *ends, *(f"{p}b{k}" for p, a in mine.items() for k in a.parts(so_far)))
    return frame.drop(TICK, "_b") if bare else frame
