"""Scalers whose parameters come from training rows alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.selection import exact_quantiles

SCALERS = ("standard", "robust")

#: Rows of a group up to which its distinct values may stand in one aggregation buffer.
BUFFERED_ROWS = 1_000_000
_QUARTERS = (0.25, 0.5, 0.75)


def _parameters(features: Sequence[str], kind: str) -> list[Column]:
    """Centre and scale of each feature; a scale of 0 counts as 1."""
    out = []
    for f in features:
        if kind == "standard":
            centre, scale = F.avg(f), F.stddev_pop(f)
        else:
            q = F.percentile(F.col(f), F.array(*map(F.lit, _QUARTERS)))
            centre, scale = q[1], q[2] - q[0]
        out += [centre.alias(f"{f}__centre"), F.when(scale == 0, 1.0).otherwise(scale).alias(f"{f}__scale")]
    return out


def _selected(rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Robust parameters by radix selection: a row a group."""
    fitted = []
    for key, quantiles in exact_quantiles(rows, features, _QUARTERS, keys=keys):
        values = []
        for f in features:
            q = quantiles[f]
            values += [None, None] if q is None else [q[1], 1.0 if q[2] == q[0] else q[2] - q[0]]
        fitted.append((*key, *values))
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"`{f}__{x}` double" for f in features for x in ("centre", "scale")]
    return rows.sparkSession.createDataFrame(fitted, ", ".join(kinds))


def fit_by(rows: DataFrame, features: Sequence[str], *, kind: str = "standard", keys: Sequence[str] = ("fold_id",), buffered_rows: int = BUFFERED_ROWS) -> DataFrame:
    """Parameters by fold from the rows given, which have to be training rows only: all folds in one job.

    Exact quantiles of a group of more than ``buffered_rows`` rows would take its distinct values into one
    task's memory; where the largest group has more, they are selected digit by digit, with equal results.
    """
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}")
    if kind == "robust":
        largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if largest > buffered_rows:
            return _selected(rows, features, keys)
    return rows.groupBy(*keys).agg(*_parameters(features, kind))


def scale_by(rows: DataFrame, parameters: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("fold_id",), few: bool | None = None) -> DataFrame:
    """``rows`` with scaled features.  The parameters are one row a group: ``few`` says that they are few enough
    to go to every executor, as folds are; of other keys the optimiser decides by size."""
    few = tuple(keys) == ("fold_id",) if few is None else few
    joined = rows.join(F.broadcast(parameters) if few else parameters, list(keys))
    scaled = {f: (F.col(f) - F.col(f"{f}__centre")) / F.col(f"{f}__scale") for f in features}
    return joined.withColumns(scaled).drop(*(f"{f}__{x}" for f in features for x in ("centre", "scale")))


class TrainOnlyScaler:
    """Fit once, transform many; refitting and other columns are refused."""

    def __init__(self, kind: str = "standard"):
        if kind not in SCALERS:
            raise ValueError(f"unknown scaler {kind!r}")
        self.kind = kind
        self.features: tuple[str, ...] | None = None
        self.parameters: dict[str, tuple[float, float]] = {}

    def fit(self, rows: DataFrame, features: Sequence[str]) -> TrainOnlyScaler:
        if self.features is not None:
            raise RuntimeError("this scaler is fitted already")
        row = fit_by(rows.withColumn("_all", F.lit(0)), features, kind=self.kind, keys=("_all",)).first()
        if row is None:
            raise ValueError("no rows to fit on")
        self.features = tuple(features)
        self.parameters = {f: (row[f"{f}__centre"], row[f"{f}__scale"]) for f in features}
        return self

    def transform(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        if self.features is None:
            raise RuntimeError("this scaler is not fitted")
        if tuple(features) != self.features:
            raise ValueError("features differ from those of the fit, in name or order")
        return rows.withColumns({f: (F.col(f) - F.lit(c)) / F.lit(s) for f, (c, s) in self.parameters.items()})

    def fit_transform(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        return self.fit(rows, features).transform(rows, features)
