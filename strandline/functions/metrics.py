"""Regression and classification metrics as aggregates, one pass each, for any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGRESSION = ("rmse", "mae", "relative_rmse", "r2", "directional_accuracy", "pearson_ic")
CLASSIFICATION = ("logloss", "accuracy", "precision", "recall", "f1")
_TINY = 1e-12


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def regression_metrics(rows: DataFrame, keys: Sequence[str] = (), *, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Metrics over rows where both values are finite; all null where there is none.

    R2 is 0 for a constant target, the correlation 0 where either side is constant,
    and the relative error null where targets vanish.
    """
    both = finite(F.col(y)) & finite(F.col(p))
    t, q = F.when(both, F.col(y)), F.when(both, F.col(p))
    error = t - q
    sums = rows.groupBy(*keys).agg(
        F.count(t).alias("n"),
        F.avg(error * error).alias("_mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(t * t).alias("_square"),
        F.var_pop(t).alias("_var"),
        F.avg((F.signum(t) == F.signum(q)).cast("double")).alias("directional_accuracy"),
        F.covar_pop(t, q).alias("_cov"),
        F.stddev_pop(t).alias("_sy"),
        F.stddev_pop(q).alias("_sp"),
    )
    some = F.col("n") > 0
    rmse = F.sqrt("_mse")
    base = F.sqrt("_square")
    steady = (F.col("_sy") <= _TINY) | (F.col("_sp") <= _TINY)
    return sums.select(
        *keys,
        "n",
        rmse.alias("rmse"),
        "mae",
        F.when(base > _TINY, rmse / base).alias("relative_rmse"),
        F.when(some, F.when(F.col("_var") * F.col("n") <= _TINY, 0.0).otherwise(1 - F.try_divide("_mse", "_var"))).alias("r2"),
        "directional_accuracy",
        F.when(some, F.when(steady, 0.0).otherwise(F.try_divide(F.col("_cov"), F.col("_sy") * F.col("_sp")))).alias("pearson_ic"),
    )


def classification_metrics(rows: DataFrame, keys: Sequence[str] = (), *, y: str = "y_true", p1: str = "p1", strict: bool = True) -> DataFrame:
    """Log loss with probabilities clipped at 1e-15, and scores of the class p1 >= 0.5.

    Targets other than 0 and 1 and probabilities that are not finite raise an
    error when met (``strict``), since a score over the rest would mislead.
    """
    t, q = F.col(y), F.col(p1)
    if strict:
        fine = finite(t) & finite(q) & t.isin(0.0, 1.0)
        t = F.when(fine, t).otherwise(F.raise_error(F.lit("targets must be 0 or 1 and probabilities finite")).cast("double"))
    clipped = F.greatest(F.least(q, F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -(t * F.ln(clipped) + (1 - t) * F.ln(1 - clipped))
    hit = q >= 0.5
    n = lambda c: F.count_if(c).cast("double")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(loss).alias("logloss"), n(hit & (t == 1)).alias("_tp"), n(hit & (t == 0)).alias("_fp"), n(~hit & (t == 1)).alias("_fn"), n(hit == (t == 1)).alias("_ok")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = sums.withColumns({"precision": ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")), "recall": ratio(F.col("_tp"), F.col("_tp") + F.col("_fn"))})
    return sums.select(*keys, "n", "logloss", ratio(F.col("_ok"), F.col("n")).alias("accuracy"), "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def macro_objective(rows: DataFrame, task: str, *, fold: str = "fold_id", entity: str = "ticker") -> DataFrame:
    """One row: the mean over folds of the mean over tickers of the objective; a score that is not finite raises."""
    if task == "regression":
        scores = regression_metrics(rows, (fold, entity)).withColumn("score", F.col("relative_rmse"))
    else:
        scores = classification_metrics(rows, (fold, entity)).withColumn("score", F.col("logloss"))
    checked = F.when(finite(F.col("score")), F.col("score")).otherwise(F.raise_error(F.lit("a ticker's score is not finite")).cast("double"))
    return scores.groupBy(fold).agg(F.avg(checked).alias("fold_score")).agg(F.avg("fold_score").alias("objective"), F.count("*").alias("n_folds"))


def finite_mean(values: Sequence[float], *, label: str) -> float:
    """The mean of driver-side values; none at all or one that is not finite is an error."""
    import math

    from strandline.plans.search import InvalidTrial

    if not values:
        raise InvalidTrial(f"no values for {label}")
    if not all(math.isfinite(v) for v in values):
        raise InvalidTrial(f"a value that is not finite in {label}")
    mean = sum(values) / len(values)
    if not math.isfinite(mean):
        raise InvalidTrial(f"the mean of {label} is not finite")
    return mean
