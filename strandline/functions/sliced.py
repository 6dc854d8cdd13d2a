"""Window work along time, for histories longer than one task should hold.

A window by ticker is one task a ticker.  Here a ticker's rows are numbered in parallel,
from counts of coarse stretches of time, and cut into slices of so many rows.  A slice also gets the rows
before it (and after it) that its windows reach: its halo.  Whatever is computed by
ticker is then computed by (ticker, slice), and halo rows are dropped.

A recursion has no end to its reach, but what it remembers falls by a factor a row: after
``settled(rho)`` rows nothing of its start is left in a double.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.recursive import BLOCK, TICK
from strandline.functions.windows import required

#: Rows of a slice.  With a halo of some 1,100 rows it stays below the 4,096 rows that a window holds
#: in memory before it takes a spillable buffer, of which a chain of windows has dozens a task.
ROWS = 2900

#: Stands for a missing day, which comes before all others.
_MISSING = -(1 << 62)


def settled(*rhos: float) -> int:
    """Rows after which a chain of recursions has forgotten where it started, to less than a double can hold."""
    return sum(math.ceil(56 * math.log(2) / math.log(1 / rho)) for rho in rhos)


def _clock(order: str, kind: str) -> Column:
    """The order column as a number: days, microseconds or itself."""
    if kind == "date":
        return F.unix_date(order).cast("double")
    if kind == "timestamp":
        return F.unix_micros(order).cast("double")
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_timestamp_ltz(F.col(order))).cast("double")
    return F.col(order).cast("double")


def stretch(panel: DataFrame, rows: int, *, order: str = "session_date") -> float:
    """Time in which the densest ticker has about ``rows`` rows: one aggregate, a row a ticker in it."""
    clock = _clock(order, dict(panel.dtypes)[order])
    spans = panel.groupBy("ticker").agg(F.count("*").alias("n"), (F.max(clock) - F.min(clock)).alias("span"))
    gap = spans.agg(F.min(F.when(F.col("span") > 0, F.col("span") / F.col("n")))).first()[0]
    return max(1e-9, (gap or 1.0) * rows)


def row_numbers(panel: DataFrame, *, order: str = "session_date", time: float) -> DataFrame:
    """``panel`` with _t, the row's number within its ticker from 0, in order of ``order`` (null first).

    Rows are dealt out by ticker and stretch of ``time``; a stretch's first number comes from the
    counts of the stretches before it, a row each.
    """
    clock = _clock(order, dict(panel.dtypes)[order])
    rows = panel.withColumn("_k", F.coalesce(F.floor(clock / time).cast("long"), F.lit(_MISSING)))
    counts = rows.groupBy(F.col("ticker").alias("_ticker"), F.col("_k").alias("_stretch")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_ticker").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_ticker", "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    rows = rows.join(first, F.col("ticker").eqNullSafe(F.col("_ticker")) & (F.col("_k") == F.col("_stretch")))
    own = F.row_number().over(Window.partitionBy("ticker", "_k").orderBy(order)) - 1
    return rows.withColumn(TICK, F.col("_first") + own).drop("_k", "_ticker", "_stretch", "_first")


def sliced(panel: DataFrame, build: Callable[[DataFrame], DataFrame], *, back: int, ahead: int = 0, rows: int = ROWS, time: float | None = None, order: str = "session_date") -> DataFrame:
    """``build(panel)``, computed slice by slice.

    ``build`` gets a frame whose ``ticker`` is a slice of one, with the ticker's own row numbers in _t and
    blocks of them in _b, and must keep both; it may look at ``back`` rows before each row and at ``ahead``
    rows after it, by windows over ``ticker``.  ``time`` is what ``stretch`` finds, unless given.
    """
    required(panel, ("ticker", order))
    if rows < 1 or back < 0 or ahead < 0:
        raise ValueError("a slice has at least one row, and a reach is not negative")
    numbers = row_numbers(panel, order=order, time=stretch(panel, rows, order=order) if time is None else time)
    t = F.col(TICK)
    # A row stands in its own slice and in those whose halo it is.
    slices = F.sequence(F.greatest(F.lit(0), F.floor((t - ahead) / rows)), F.floor((t + back) / rows))
    copies = numbers.withColumn("_slice", F.explode(slices)).withColumn("_b", F.floor(t / BLOCK).cast("int"))
    out = build(copies.withColumn("ticker", F.struct("ticker", "_slice")).drop("_slice"))
    own = out.where(F.floor(t / rows) == F.col("ticker._slice"))
    return own.withColumn("ticker", F.col("ticker.ticker")).drop(TICK, "_b")
