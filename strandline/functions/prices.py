"""Return features, targets, volatility and volume features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.rolled import Rolling, rolled
from strandline.functions.sliced import sliced
from strandline.functions.windows import checked_counts, log_ratio, log_return, over, required

HORIZONS = (1, 2, 5, 10, 20)
TARGET_HORIZONS = (1, 5)
VOLATILITY_WINDOWS = (5, 20, 60)
VOLUME_WINDOWS = (5, 20)


def return_features(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """log_return_{h}d, intraday_return, overnight_gap and high_low_range; null until h earlier rows exist."""
    required(panel, ("ticker", "session_date", "open", "high", "low", "close"))
    returns = {f"log_return_{h}d": log_return("close", h) for h in checked_counts(horizons, "horizon")}
    return panel.withColumns(
        {
            **returns,
            "intraday_return": log_ratio(F.col("close"), F.col("open")),
            "overnight_gap": log_ratio(F.col("open"), F.lag("close", 1).over(over())),
            "high_low_range": log_ratio(F.col("high"), F.col("low")),
        }
    )


def targets(panel: DataFrame, horizons: tuple[int, ...] = TARGET_HORIZONS) -> DataFrame:
    """target_return_{h}d from adjusted closes ahead, target_up_{h}d as 1.0 or 0.0; null for the last h rows."""
    required(panel, ("ticker", "session_date", "adj_close"))
    horizons = checked_counts(horizons, "horizon")
    out = panel.withColumns({f"target_return_{h}d": log_ratio(F.lead("adj_close", h).over(over()), F.col("adj_close")) for h in horizons})
    up = lambda h: F.when(F.col(f"target_return_{h}d").isNotNull(), (F.col(f"target_return_{h}d") > 0).cast("double"))
    return out.withColumns({f"target_up_{h}d": up(h) for h in horizons})


def volatility_volume_features(panel: DataFrame, *, volatility_windows: tuple[int, ...] = VOLATILITY_WINDOWS, volume_windows: tuple[int, ...] = VOLUME_WINDOWS) -> DataFrame:
    """Sample deviation of daily log returns; volume change, mean and z-score (null where the deviation is 0)."""
    required(panel, ("ticker", "session_date", "close", "volume"))
    volatility_windows = checked_counts(volatility_windows, "volatility window")
    volume_windows = checked_counts(volume_windows, "volume window")
    out = panel.withColumns({"_r": log_return("close", 1), "volume_change_1d": log_return("volume", 1)})
    deviations = [Rolling(f"volatility_{n}d", "stddev_samp", F.col("_r"), n) for n in volatility_windows] + [Rolling(f"_s{n}", "stddev_samp", F.col("volume"), n) for n in volume_windows]
    out = rolled(out, [*deviations, *(Rolling(f"volume_sma_{n}d", "avg", F.col("volume"), n) for n in volume_windows)])
    z = lambda n: F.try_divide(F.col("volume") - F.col(f"volume_sma_{n}d"), F.col(f"_s{n}"))
    return out.withColumns({f"volume_zscore_{n}d": z(n) for n in volume_windows}).drop("_r", *(f"_s{n}" for n in volume_windows))


def price_features(panel: DataFrame, *, slice_rows: int | None = None) -> DataFrame:
    """Returns, volatility, volume and targets together; with ``slice_rows`` slice by slice, not ticker by ticker."""
    build = lambda frame: targets(volatility_volume_features(return_features(frame)))
    reach = 1 + max(*HORIZONS, *VOLATILITY_WINDOWS, *VOLUME_WINDOWS)
    return sliced(panel, build, back=reach, ahead=max(TARGET_HORIZONS), rows=slice_rows) if slice_rows else build(panel)
