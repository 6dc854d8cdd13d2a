"""Joins with a promise about their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Right sides of at most so many bytes, as the optimiser estimates them, are sent to all executors.
BROADCAST_BYTES = 64 << 20


def repeated_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their counts."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(frame: DataFrame, keys: list[str], what: str = "right side") -> None:
    if found := repeated_keys(frame, keys).take(1):
        raise ValueError(f"{what} has repeated keys, e.g. {found[0].asDict()}")


def estimated_bytes(frame: DataFrame) -> int:
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], *, check: bool = False) -> DataFrame:
    """Left equi-join against a side with one row a key.

    With ``check`` the promise is verified by a job; else it is verified in the
    join itself, whose repeated keys raise an error when they are met.
    """
    if check:
        assert_unique(right, keys)
    else:
        others = [c for c in right.columns if c not in keys]
        grouped = right.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in others))
        guard = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("right side has repeated keys")).cast("boolean"))
        right = grouped.where(guard).drop("_n")
    if estimated_bytes(right) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    return left.join(right, keys, "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    assert_unique(left, keys, "left side")
    return many_to_one(left, right, keys, check=True)
