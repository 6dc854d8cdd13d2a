"""A seeded synthetic panel for protocol runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.technical import COLUMNS as TECHNICAL

FEATURES = (
    *TECHNICAL,
    *("volatility_5d", "volatility_20d", "volatility_60d", "volume_change_1d"),
    *("volume_sma_5d", "volume_zscore_5d", "volume_sma_20d", "volume_zscore_20d"),
)
TARGETS = ("target_return_1d", "target_return_5d", "target_up_1d", "target_up_5d")


def business_days(spark: SparkSession, start: date, n: int) -> DataFrame:
    """(i, session_date): the first ``n`` weekdays from ``start``."""
    days = spark.range(0, n + n // 5 * 2 + 10).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("session_date"))
    weekdays = days.where(F.weekday("session_date") < 5)
    # Weekdays before a date follow from arithmetic, so no global window is needed.
    first = start.toordinal()
    lead = sum((first + k - 1) % 7 < 5 for k in range((7 - (first - 1) % 7) % 7))
    since = F.datediff("session_date", F.lit(start))
    skip = (7 - (first - 1) % 7) % 7
    week = F.floor((since - skip) / 7)
    i = F.when(since < skip, F.least(since, F.lit(max(lead - 1, 0)))).otherwise(lead + week * 5 + (since - skip) % 7)
    return weekdays.select(i.cast("int").alias("i"), "session_date").where(F.col("i") < n)


def pipeline_panel(spark: SparkSession, *, n_days: int = 150, tickers: tuple[str, ...] = ("AAA", "BBB"), start: date = date(2026, 1, 1), seed: int = 42) -> DataFrame:
    """Random features by ticker and day, alternating targets; the same seed gives the same panel."""
    days = business_days(spark, start, n_days)
    names = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    rows = days.crossJoin(F.broadcast(names))  # a handful of names
    even = F.col("i") % 2 == 0
    normal = lambda f: (  # noqa: E731  Box-Muller from hashes of the row's key, so the layout does not matter
        F.sqrt(-2 * F.ln((F.pmod(F.xxhash64("ticker", "i", F.lit(f"{f}a{seed}")), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))))
        * F.cos(F.lit(6.283185307179586) * F.pmod(F.xxhash64("ticker", "i", F.lit(f"{f}b{seed}")), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    )
    targets = {
        "target_return_1d": F.when(even, 0.01).otherwise(-0.01),
        "target_return_5d": F.when(even, 0.02).otherwise(-0.02),
        "target_up_1d": F.when(even, 1.0).otherwise(0.0),
        "target_up_5d": F.when(even, 1.0).otherwise(0.0),
    }
    return rows.select("ticker", "session_date", *(normal(f).alias(f) for f in FEATURES), *(c.alias(t) for t, c in targets.items()))
