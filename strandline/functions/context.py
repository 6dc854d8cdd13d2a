"""Market, sector, regime and cross-asset context.

Index series are windowed on their own small one-row-a-day frames before they
are joined; breadth is an aggregate by day.  Every join's right side is checked
or known to have one row a key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.medians import expanding_median
from strandline.functions.rolled import Rolling, rolled
from strandline.functions.sliced import sliced
from strandline.functions.windows import log_return, required, rolling
from strandline.operators.joins import many_to_one

SPANS = (1, 5, 20)

MARKET_COLUMNS = (
    *(f"market_return_{n}d" for n in SPANS),
    *("market_volatility_20d", "market_sma_20", "market_sma_50", "market_close_to_sma_20", "market_close_to_sma_50"),
    *(f"stock_vs_market_return_{n}d" for n in SPANS),
    *("market_breadth_1d", "market_breadth_5d"),
)
SECTOR_COLUMNS = (*(f"sector_return_{n}d" for n in SPANS), "sector_volatility_20d", *(f"stock_vs_sector_return_{n}d" for n in SPANS), "sector_breadth_1d")
REGIME_COLUMNS = ("market_regime_trend", "market_regime_volatility")
CROSS_ASSET_COLUMNS = ("india_vix", "india_vix_change_1d", "usd_inr_return_1d", "crude_return_1d")
ALL_COLUMNS = MARKET_COLUMNS + SECTOR_COLUMNS + REGIME_COLUMNS + CROSS_ASSET_COLUMNS


def breadth(value: str):
    """Share of positive values; missing ones count as not positive and stay in the denominator."""
    return F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0))


def _index_windows(index: DataFrame, prefix: str) -> DataFrame:
    out = index.withColumns({f"{prefix}_return_{n}d": log_return("close", n) for n in SPANS})
    means = [Rolling(f"{prefix}_sma_{n}", "avg", F.col("close"), n) for n in (20, 50)]
    out = rolled(out, [Rolling(f"{prefix}_volatility_20d", "stddev_samp", F.col(f"{prefix}_return_1d"), 20), *means])
    return out.withColumns({f"{prefix}_close_to_sma_{n}": F.try_divide(F.col("close"), F.col(f"{prefix}_sma_{n}")) - 1 for n in (20, 50)})


def index_features(index: DataFrame, prefix: str = "market", *, slice_rows: int | None = None) -> DataFrame:
    """{prefix}_return, volatility, sma and close_to_sma of a series with one row a day; with
    ``slice_rows`` a long one is cut into slices of so many rows."""
    required(index, ("session_date", "close"))
    alone = index.select(F.lit(0).alias("ticker"), "session_date", "close")
    build = lambda frame: _index_windows(frame, prefix)
    out = sliced(alone, build, back=51, rows=slice_rows) if slice_rows else build(alone)
    return out.drop("ticker", "close")


def regime(index: DataFrame, *, trend: float = 0.02, high: float = 1.5, low: float = 0.75, least: int = 60, blocks: int | None = None) -> DataFrame:
    """Trend and volatility regime of ``index_features``, by day: 1, 0 or -1, and 0 while warming up.

    Volatility is held against its median over the series so far, in day order.  A growing window takes
    that median anew for each row, in one task: enough for years of days.  With ``blocks``, a long
    series is cut into so many blocks of time, which are walked side by side (some jobs run at once).
    """
    v = F.col("market_volatility_20d")
    if blocks:
        out = expanding_median(index, "market_volatility_20d", blocks=blocks)
        out = out.withColumn("_m", F.when(F.col("_n") >= least, F.col("_median"))).drop("_median", "_n")
    else:
        so_far = Window.partitionBy(F.lit(0)).orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
        out = index.withColumn("_m", F.when(F.count(v).over(so_far) >= least, F.percentile(v, F.lit(0.5)).over(so_far)))
    gap = F.col("market_close_to_sma_50")
    return out.withColumns(
        {
            "market_regime_trend": F.when(gap > trend, 1.0).when(gap < -trend, -1.0).otherwise(0.0),
            "market_regime_volatility": F.when(v > F.col("_m") * high, 1.0).when(v < F.col("_m") * low, -1.0).otherwise(0.0),
        }
    ).drop("_m")


def _own_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumns({f"stock_return_{n}d_context": log_return("close", n) for n in SPANS})


def market_context(panel: DataFrame, *, market_index: DataFrame) -> DataFrame:
    """``MARKET_COLUMNS`` and ``REGIME_COLUMNS``; the stock's own context returns stay, too."""
    required(panel, ("ticker", "session_date", "close", "sector"))
    out = many_to_one(_own_returns(panel), regime(index_features(market_index)), ["session_date"])
    out = out.withColumns({f"market_regime_{k}": F.coalesce(f"market_regime_{k}", F.lit(0.0)) for k in ("trend", "volatility")})
    out = out.withColumns({f"stock_vs_market_return_{n}d": F.col(f"stock_return_{n}d_context") - F.col(f"market_return_{n}d") for n in SPANS})
    # Counts by day are combined before the exchange; a window by day would move every row.
    days = _own_returns(panel).groupBy("session_date").agg(breadth("stock_return_1d_context").alias("market_breadth_1d"), breadth("stock_return_5d_context").alias("market_breadth_5d"))
    return out.join(days, "session_date", "left")


def _with_volatility(daily: DataFrame) -> DataFrame:
    return daily.withColumn("sector_volatility_20d", rolling("stddev_samp", F.col("sector_return_1d"), 20, ("sector",)))


def sector_daily(panel: DataFrame) -> DataFrame:
    """Equal-weight returns, breadth and volatility by sector and day (volatility in day order)."""
    daily = _own_returns(panel).groupBy("sector", "session_date").agg(*(F.avg(f"stock_return_{n}d_context").alias(f"sector_return_{n}d") for n in SPANS), breadth("stock_return_1d_context").alias("sector_breadth_1d"))
    return _with_volatility(daily)


def sector_context(panel: DataFrame) -> DataFrame:
    """``SECTOR_COLUMNS``; helper columns are dropped."""
    required(panel, ("ticker", "session_date", "close", "sector"))
    helpers = [f"stock_return_{n}d_context" for n in SPANS]
    out = _own_returns(panel.drop(*helpers)).join(sector_daily(panel.drop(*helpers)), ["sector", "session_date"], "left")
    out = out.withColumns({f"stock_vs_sector_return_{n}d": F.col(f"stock_return_{n}d_context") - F.col(f"sector_return_{n}d") for n in SPANS})
    return out.drop(*helpers)


def cross_asset_context(panel: DataFrame, *, india_vix: DataFrame | None = None, usd_inr: DataFrame | None = None, crude: DataFrame | None = None) -> DataFrame:
    """Level and simple change of the volatility index, log returns of the others; null where a series is absent."""
    series: Mapping[str, DataFrame | None] = {"india_vix": india_vix, "usd_inr": usd_inr, "crude": crude}
    out = panel
    for name, frame in series.items():
        if frame is None:
            continue
        required(frame, ("session_date", "close"))
        if name == "india_vix":
            before = F.lag("close", 1).over(Window.partitionBy(F.lit(0)).orderBy("session_date"))
            side = frame.select("session_date", F.col("close").alias("india_vix"), (F.try_divide(F.col("close"), before) - 1).alias("india_vix_change_1d"))
        else:
            side = frame.select("session_date", log_return("close", 1, ()).alias(f"{name}_return_1d"))
        out = many_to_one(out, side, ["session_date"])
    return out.withColumns({c: F.lit(None).cast("double") for c in CROSS_ASSET_COLUMNS if c not in out.columns})


def day_context(panel: DataFrame) -> DataFrame:
    """By sector and day: ``sector_daily`` with the market's breadth of the day, from one pass over ``panel``.

    Counts and sums of a sector's day are the parts of the market's, so both come from one
    aggregate; what is left of it, a row a sector and day, goes on in windows.
    """
    ups = lambda n: F.count_if(F.col(f"stock_return_{n}d_context") > 0)
    parts = _own_returns(panel).groupBy("sector", "session_date").agg(
        *(F.avg(f"stock_return_{n}d_context").alias(f"sector_return_{n}d") for n in SPANS), breadth("stock_return_1d_context").alias("sector_breadth_1d"), F.count("*").alias("_n"), ups(1).alias("_u1"), ups(5).alias("_u5")
    )
    day = Window.partitionBy("session_date")
    out = parts.withColumns({f"market_breadth_{n}d": F.sum(f"_u{n}").over(day) / F.sum("_n").over(day) for n in (1, 5)})
    out = _with_volatility(out.drop("_n", "_u1", "_u5"))
    return out.withColumns({c: F.when(F.col("sector").isNotNull(), F.col(c)) for c in (*(f"sector_return_{n}d" for n in SPANS), "sector_volatility_20d", "sector_breadth_1d")})


def context_features(panel: DataFrame, *, market_index: DataFrame, india_vix: DataFrame | None = None, usd_inr: DataFrame | None = None, crude: DataFrame | None = None) -> DataFrame:
    """All context.  What is by day and sector comes from one aggregate of the panel and is joined
    once; what is by day alone (index, regime, cross assets) is joined as it is in the parts."""
    required(panel, ("ticker", "session_date", "close", "sector"))
    days = day_context(panel).withColumnsRenamed({"sector": "_sector", "session_date": "_day"})
    # A day's breadth also holds for stocks without a sector.
    out = _own_returns(panel).join(days, F.col("sector").eqNullSafe(F.col("_sector")) & (F.col("session_date") == F.col("_day")), "left").drop("_sector", "_day")
    out = many_to_one(out, regime(index_features(market_index)), ["session_date"])
    out = out.withColumns({f"market_regime_{k}": F.coalesce(f"market_regime_{k}", F.lit(0.0)) for k in ("trend", "volatility")})
    out = out.withColumns({f"stock_vs_{side}_return_{n}d": F.col(f"stock_return_{n}d_context") - F.col(f"{side}_return_{n}d") for side in ("market", "sector") for n in SPANS})
    return cross_asset_context(out, india_vix=india_vix, usd_inr=usd_inr, crude=crude)
