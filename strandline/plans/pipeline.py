"""The composed feature path: panel to model dataset, over one exchange by ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandline.functions.context import ALL_COLUMNS, context_features
from strandline.functions.prices import return_features, targets, volatility_volume_features
from strandline.functions.technical import COLUMNS as TECHNICAL
from strandline.functions.technical import technical_features
from strandline.plans.dataset import ModelDataset, build_dataset

RETURNS = ("log_return_1d", "log_return_2d", "log_return_5d", "log_return_10d", "log_return_20d", "intraday_return", "overnight_gap", "high_low_range")
VOLATILITY = ("volatility_5d", "volatility_20d", "volatility_60d", "volume_change_1d", "volume_sma_5d", "volume_zscore_5d", "volume_sma_20d", "volume_zscore_20d")


def feature_frame(panel: DataFrame, *, market_index: DataFrame | None = None, **cross_assets: DataFrame | None) -> DataFrame:
    """All per-ticker features and targets, and the context where an index is given."""
    out = targets(technical_features(volatility_volume_features(return_features(panel))))
    return context_features(out, market_index=market_index, **cross_assets) if market_index is not None else out


def model_dataset(panel: DataFrame, *, market_index: DataFrame | None = None, target_columns: tuple[str, ...] = ("target_return_1d",), **cross_assets: DataFrame | None) -> ModelDataset:
    frame = feature_frame(panel, market_index=market_index, **cross_assets)
    context = tuple(c for c in ALL_COLUMNS if market_index is not None and (c.startswith(("market", "sector", "stock")) or cross_assets.get({"india_vix": "india_vix", "india_vix_change_1d": "india_vix", "usd_inr_return_1d": "usd_inr", "crude_return_1d": "crude"}.get(c, ""))))
    return build_dataset(frame, feature_columns=(*RETURNS, *VOLATILITY, *TECHNICAL, *context), target_columns=target_columns)
