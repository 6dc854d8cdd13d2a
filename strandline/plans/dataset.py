"""The model dataset: one DataFrame and the roles of its columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.metrics import finite

KEYS = ("ticker", "session_date")
ACTIVE_HORIZONS = (1, 5)
_TARGET = re.compile(r"target_(return|up)_(\d+)d")


@dataclass(frozen=True)
class TargetSpec:
    name: str
    task: str
    horizon: int

    def __post_init__(self):
        if self.task not in ("regression", "classification"):
            raise ValueError(f"unknown task {self.task!r}")
        if self.horizon <= 0:
            raise ValueError("the horizon is positive")


def target_spec(name: str) -> TargetSpec:
    """The contract of an active target: returns are regression, ups classification."""
    match = _TARGET.fullmatch(name)
    if not match:
        raise ValueError(f"{name!r} is no target; active ones are target_return_1d, target_return_5d, target_up_1d, target_up_5d")
    if (horizon := int(match[2])) not in ACTIVE_HORIZONS:
        raise ValueError(f"{name!r} has an inactive horizon; active ones are {ACTIVE_HORIZONS}")
    return TargetSpec(name, "regression" if match[1] == "return" else "classification", horizon)


@dataclass(frozen=True)
class ModelDataset:
    rows: DataFrame
    features: tuple[str, ...]
    targets: tuple[str, ...]
    keys: tuple[str, ...] = KEYS

    def with_rows(self, rows: DataFrame) -> ModelDataset:
        return replace(self, rows=rows)


def _names(columns: Sequence[str] | str, what: str) -> tuple[str, ...]:
    columns = (columns,) if isinstance(columns, str) else tuple(columns)
    if not columns:
        raise ValueError(f"no {what}")
    if len(set(columns)) != len(columns):
        raise ValueError(f"{what} repeat")
    return columns


def check_structure(frame: DataFrame, features: Sequence[str], targets: Sequence[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Names, types and disjointness, from the schema alone."""
    features, targets = _names(features, "features"), _names(targets, "targets")
    if both := set(features) & set(targets):
        raise ValueError(f"both feature and target: {sorted(both)}")
    if leaks := [f for f in features if f.startswith("target_")]:
        raise ValueError(f"targets among the features: {leaks}")
    if missing := [c for c in (*KEYS, *features, *targets) if c not in frame.columns]:
        raise ValueError(f"missing columns: {missing}")
    if wrong := [f.name for f in frame.schema.fields if f.name in (*features, *targets) and not isinstance(f.dataType, T.NumericType)]:
        raise ValueError(f"not numeric: {wrong}")
    return features, targets


def with_row_id(frame: DataFrame) -> DataFrame:
    """row_id by (session_date, ticker), from 0 without gaps, without one global sort:
    rows before a day come from the calendar's counts, the rank within a day from a window by day."""
    counts = frame.groupBy("session_date").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("session_date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("session_date").orderBy("ticker")) - 1
    return frame.join(F.broadcast(starts), "session_date").withColumn("row_id", (F.col("_start") + rank).cast("long")).drop("_start")


def build_dataset(frame: DataFrame, *, feature_columns: Sequence[str], target_columns: Sequence[str], drop_incomplete: bool = True) -> ModelDataset:
    """Check, project, reject infinities and repeated keys, drop incomplete rows, number the rest."""
    features, targets = check_structure(frame, feature_columns, target_columns)
    values = (*features, *targets)
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = frame.select(*KEYS, *(clean(c).alias(c) for c in values))
    infinite = [F.count_if(F.coalesce(F.abs(c) == float("inf"), F.lit(False))).alias(c) for c in values]
    found = rows.agg(*infinite, F.count_if(F.col("session_date").isNull() | F.col("ticker").isNull()).alias("null key")).first().asDict()
    if bad := {k: v for k, v in found.items() if v}:
        raise ValueError(f"infinite values or null keys: {bad}")
    if rows.groupBy(*KEYS).count().where("count > 1").take(1):
        raise ValueError("repeated (ticker, session_date)")
    if drop_incomplete:
        rows = rows.na.drop("any", subset=list(values))
        if not rows.take(1):
            raise ValueError("no complete rows remain")
    return ModelDataset(with_row_id(rows), features, targets)


def check_target(rows: DataFrame, spec: TargetSpec) -> None:
    """The target's values are there, finite, and 0 or 1 for classification."""
    y = F.col(spec.name)
    bad = ~finite(y) if spec.task == "regression" else ~finite(y) | ~F.coalesce(y.isin(0.0, 1.0), F.lit(False))
    n, wrong = rows.agg(F.count("*"), F.count_if(bad)).first()
    if not n:
        raise ValueError("no target values")
    if wrong:
        raise ValueError(f"{wrong} unusable values in {spec.name}")


def lookback_sequences(rows: DataFrame, features: Sequence[str], *, lookback: int = 10, max_lookback: int | None = None) -> DataFrame:
    """``rows`` with ``sequence``, the feature vectors of the last ``lookback`` rows of the ticker.

    Only rows with ``max_lookback`` rows of history (their own included) remain,
    so models of different lookbacks score the same rows.
    """
    longest = lookback if max_lookback is None else max_lookback
    if lookback <= 0 or longest < lookback:
        raise ValueError("lookback is positive and at most max_lookback")
    w = Window.partitionBy("ticker").orderBy("session_date")
    vector = F.array(*(F.col(f).cast("double") for f in features))
    out = rows.withColumns({"sequence": F.collect_list(vector).over(w.rowsBetween(-(lookback - 1), 0)), "_n": F.row_number().over(w)})
    return out.where(F.col("_n") >= longest).drop("_n")
