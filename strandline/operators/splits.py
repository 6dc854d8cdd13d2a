"""Leakage-safe temporal splits as tables.

A split is a small table of session ranges per fold (the fold table), built on
the driver from the length of the calendar.  One range join turns it into
(fold_id, role) per row for all folds at once; purging is a lead within fold,
role and ticker, taken after rows were excluded, so it sees the subset only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """(session_date, session_idx) of all distinct days, numbered from 0.

    Days are few whatever the number of rows, so one ordered partition is enough.
    """
    days = panel.select("session_date").distinct()
    return days.withColumn("session_idx", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("session_date")) - 1).cast("int"))


def with_sessions(panel: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(calendar(panel)), "session_date")


@dataclass(frozen=True)
class Fold:
    """Half-open session ranges; ``embargo`` is taken out of ``embargo_role``."""

    fold_id: int
    train: tuple[int, int]
    val: tuple[int, int]
    test: tuple[int, int] | None = None
    embargo: tuple[int, int] | None = None
    embargo_role: str = "train"
    val_limit: int | None = None  # the session that labels of validation rows must come before


def chronological_fold(n: int, *, train_ratio: float = 0.7, val_ratio: float = 0.15, test_ratio: float = 0.15, target_horizon: int = 5, embargo_sessions: int = 0) -> Fold:
    """Train, validation and test by shares of the calendar."""
    if train_ratio <= 0 or val_ratio <= 0 or test_ratio < 0:
        raise ValueError("train and validation ratios are positive, the test ratio is not negative")
    if not math.isclose(train_ratio + val_ratio + test_ratio, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("ratios must sum to 1")
    if target_horizon <= 0:
        raise ValueError("target_horizon is positive")
    if n < 3:
        raise ValueError(f"{n} sessions; at least 3 are needed")
    train, val = math.floor(n * train_ratio), math.floor(n * val_ratio)
    if test_ratio == 0:
        if not 0 < train < n:
            raise ValueError(f"{n} sessions are too few for these ratios")
        return Fold(0, (0, train), (train, n))
    train, val = max(1, train), max(1, val)
    end = min(train + val, n)
    if end == n:  # rounding left no test session
        end = n - 1
    if end <= train:
        raise ValueError(f"{n} sessions are too few: a part would be empty")
    embargo = (end, end + embargo_sessions) if embargo_sessions > 0 else None
    return Fold(0, (0, train), (train, end), (end, n), embargo, "test", end)


def walk_forward_folds(n: int, *, min_train_sessions: int = 60, val_sessions: int = 20, step_sessions: int | None = None, target_horizon: int = 5, embargo_sessions: int = 0, expanding: bool = True) -> list[Fold]:
    """Growing or rolling training ranges, each followed by its validation range.

    The embargo keeps the first sessions after the previous validation range out
    of training; with a step equal to that range they are no training rows anyway.
    """
    if min_train_sessions <= 0 or val_sessions <= 0 or target_horizon <= 0:
        raise ValueError("sessions and horizon are positive")
    step = val_sessions if step_sessions is None else step_sessions
    if step < val_sessions:
        raise ValueError("step_sessions is at least val_sessions, so that validation ranges do not overlap")
    if n < min_train_sessions + target_horizon + val_sessions:
        raise ValueError(f"{n} sessions are too few")
    folds: list[Fold] = []
    for i, end in enumerate(range(min_train_sessions, n - val_sessions + 1, step)):
        begin = 0 if expanding else end - min_train_sessions
        stop = end + val_sessions
        embargo = (folds[-1].val[1], folds[-1].val[1] + embargo_sessions) if folds and embargo_sessions > 0 else None
        folds.append(Fold(i, (begin, end), (end, stop), None, embargo, "train", stop if stop < n else None))
    return folds


def inner_selection_fold(n: int, *, selection_fraction: float = 0.2, min_selection_sessions: int = 5) -> Fold:
    """Fit and selection ranges inside a training part: selection is the latest sessions."""
    if not 0 < selection_fraction < 0.5 or min_selection_sessions <= 0:
        raise ValueError("selection_fraction is between 0 and 0.5, min_selection_sessions positive")
    size = max(min_selection_sessions, math.ceil(n * selection_fraction))
    if n <= size + 2:
        raise ValueError(f"{n} sessions are too few for a selection of {size}")
    return Fold(0, (0, n - size), (n - size, n))


def protocol_folds(n: int, *, min_selection_sessions: int = 5) -> list[Fold]:
    """The two inner folds: selection at 60 to 80 % and at 80 to 100 % of the sessions."""
    size = max(min_selection_sessions, math.ceil(n * 0.2))
    end = math.floor(n * 0.8)
    if end <= size + 2:
        raise ValueError(f"{n} sessions are too few for two inner folds")
    return [Fold(1, (0, end - size), (end - size, end)), Fold(2, (0, n - size), (n - size, n))]


def fold_table(panel: DataFrame, folds: list[Fold]) -> DataFrame:
    """(fold_id, role, lo, hi, out_lo, out_hi, label_limit), one row a fold and role."""
    rows = []
    for f in folds:
        for role, span, limit in (("train", f.train, f.val[0]), ("val", f.val, f.val_limit), ("test", f.test, None)):
            if span is not None:
                out = f.embargo if f.embargo and f.embargo_role == role else (-1, -1)
                rows.append((f.fold_id, role, span[0], span[1] - 1, out[0], out[1] - 1 if out[1] >= 0 else -1, limit))
    return panel.sparkSession.createDataFrame(rows, "fold_id int, role string, lo int, hi int, out_lo int, out_hi int, label_limit int")


def assign_roles(panel: DataFrame, folds: list[Fold], *, horizon: int) -> DataFrame:
    """Rows of ``panel`` (with session_idx) by fold and role, with ``status``.

    ``status`` is "kept", "embargoed", or "purged": its label, ``horizon`` rows of
    its ticker ahead within what the role still holds, is missing or reaches the
    next part.  Embargo comes first, so labels skip embargoed rows; the last
    validation part has no next part and is not purged.
    """
    table = fold_table(panel, folds)
    # The fold table has three rows a fold and is made on the driver.
    joined = panel.join(F.broadcast(table), F.col("session_idx").between(F.col("lo"), F.col("hi")))
    out = joined.withColumn("_out", F.col("session_idx").between(F.col("out_lo"), F.col("out_hi")))
    w = Window.partitionBy("ticker", "fold_id", "role", "_out").orderBy("session_idx")
    out = out.withColumn("_label", F.lead("session_idx", horizon).over(w))
    unsafe = F.col("label_limit").isNotNull() & (F.col("_label").isNull() | (F.col("_label") >= F.col("label_limit")))
    status = F.when(F.col("_out"), "embargoed").when(unsafe, "purged").otherwise("kept")
    return out.withColumn("status", status).drop("lo", "hi", "out_lo", "out_hi", "label_limit", "_out", "_label")


def chronological_split(panel: DataFrame, *, target_horizon: int = 5, **options) -> DataFrame:
    n = calendar(panel).count()
    return assign_roles(with_sessions(panel), [chronological_fold(n, target_horizon=target_horizon, **options)], horizon=target_horizon)


def walk_forward_split(panel: DataFrame, *, target_horizon: int = 5, **options) -> DataFrame:
    n = calendar(panel).count()
    return assign_roles(with_sessions(panel), walk_forward_folds(n, target_horizon=target_horizon, **options), horizon=target_horizon)


def inner_folds(panel: DataFrame, *, target_horizon: int, **options) -> DataFrame:
    n = calendar(panel).count()
    return assign_roles(with_sessions(panel), protocol_folds(n, **options), horizon=target_horizon)


def context_rows(panel: DataFrame, folds: list[Fold]) -> DataFrame:
    """(fold_id, all rows before the fold's selection): history for sequences, purge gap included."""
    starts = panel.sparkSession.createDataFrame([(f.fold_id, f.val[0]) for f in folds], "fold_id int, before int")
    return panel.join(F.broadcast(starts), F.col("session_idx") < F.col("before")).drop("before")


def label_outcome_dates(panel: DataFrame, horizon: int) -> DataFrame:
    """The day on which each row's label is known, ``horizon`` rows of its ticker ahead; null at the end."""
    if horizon <= 0:
        raise ValueError("horizon is positive")
    return panel.withColumn("outcome_date", F.lead("session_date", horizon).over(Window.partitionBy("ticker").orderBy("session_date")))


def purge_train_horizon(subset: DataFrame, *, val_start, horizon: int) -> DataFrame:
    """Rows of ``subset`` whose label, within the subset, is known before ``val_start``."""
    return label_outcome_dates(subset, horizon).where(F.col("outcome_date") < F.lit(val_start)).drop("outcome_date")


def protect_validation_horizon(subset: DataFrame, *, test_start, horizon: int) -> DataFrame:
    """The same towards the test part; everything stays where there is none."""
    return subset if test_start is None else purge_train_horizon(subset, val_start=test_start, horizon=horizon)


def apply_embargo(candidates: DataFrame, panel: DataFrame, *, start, sessions: int) -> DataFrame:
    """``candidates`` without the first ``sessions`` days of the panel's calendar from ``start`` on."""
    if sessions <= 0:
        return candidates
    window = panel.select("session_date").distinct().where(F.col("session_date") >= F.lit(start)).orderBy("session_date").limit(sessions)
    return candidates.join(F.broadcast(window), "session_date", "left_anti")


def split_counts(roles: DataFrame) -> DataFrame:
    """Raw, kept, purged and embargoed rows and day bounds by fold and role."""
    n = lambda s: F.count_if(F.col("status") == s)
    return roles.groupBy("fold_id", "role").agg(
        F.count("*").alias("n_raw"), n("kept").alias("n_kept"), n("purged").alias("n_purged"), n("embargoed").alias("n_embargoed"), F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date")
    )
