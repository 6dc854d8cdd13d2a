"""Window helpers.  All per-ticker features share one window order, hence one exchange."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BY_TICKER = ("ticker",)


BY_DAY = ("session_date",)


def over(keys: tuple[str, ...] = BY_TICKER, order: tuple[str, ...] = BY_DAY) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)


def last_rows(n: int, keys: tuple[str, ...] = BY_TICKER, order: tuple[str, ...] = BY_DAY) -> WindowSpec:
    return over(keys, order).rowsBetween(-(n - 1), 0)


def full(value: Column, result: Column, n: int, spec: WindowSpec) -> Column:
    """``result`` where the window holds ``n`` values, else null: exact warm-up."""
    return F.when(F.count(value).over(spec) >= n, result)


def rolling(kind: str, value: Column, n: int, keys: tuple[str, ...] = BY_TICKER, order: tuple[str, ...] = BY_DAY) -> Column:
    """A gated rolling avg, stddev_samp, stddev_pop, min or max of the last ``n`` rows."""
    spec = last_rows(n, keys, order)
    return full(value, getattr(F, kind)(value).over(spec), n, spec)


def log_ratio(a: Column, b: Column) -> Column:
    return F.ln(F.try_divide(a, b))


def log_return(value: str, n: int, keys: tuple[str, ...] = BY_TICKER) -> Column:
    return log_ratio(F.col(value), F.lag(value, n).over(over(keys)))


def checked_counts(values: tuple[int, ...], name: str) -> tuple[int, ...]:
    """Horizons or windows: not empty, positive whole numbers, no repeats."""
    values = tuple(values)
    if not values:
        raise ValueError(f"at least one {name} is required")
    if any(isinstance(v, bool) or not isinstance(v, int) or v <= 0 for v in values):
        raise ValueError(f"{name}s must be positive integers")
    if len(set(values)) != len(values):
        raise ValueError(f"{name}s must be unique")
    return values


def required(frame, columns: tuple[str, ...]) -> None:
    if missing := sorted(set(columns) - set(frame.columns)):
        raise ValueError(f"missing required columns: {', '.join(missing)}")
