"""Slices, blocks and selection against the plain windows and aggregates they stand for."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import context, medians, prices, rolled, sliced, technical
from strandline.functions.recursive import numbered
from strandline.operators import scaling, selection
from strandline.session import ship


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    ship(spark)


@pytest.fixture(scope="module")
def history(spark):
    """One long ticker, one short, one with gaps, in no order."""
    rng, rows = random.Random(4), []
    for ticker, n in (("LONG", 1500), ("SHORT", 30), ("GAPS", 400), (None, 90)):
        price = 100.0
        for i in range(n):
            price *= math.exp(rng.gauss(0, 0.02))
            close = None if ticker == "GAPS" and i % 97 == 50 else price
            day = i if ticker != "GAPS" else i * 3 + i // 100 * 400
            rows.append((ticker, day, price * 0.99, price * 1.01, price * 0.98, close, close, float(rng.randint(1, 9)) if i % 11 else 1e6))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "ticker string, d int, open double, high double, low double, close double, adj_close double, volume double")
    return frame.withColumn("session_date", F.date_add(F.lit("2000-01-03"), F.col("d"))).drop("d").persist()


def close_rows(a, b, columns, tolerance=1e-9):
    key = lambda r: (r["ticker"] or "", r["session_date"])
    a, b = (sorted(x.collect(), key=key) for x in (a, b))
    assert [key(r) for r in a] == [key(r) for r in b]
    for x, y in zip(a, b, strict=True):
        for c in columns:
            assert (x[c] is None) == (y[c] is None), (c, x, y)
            assert x[c] is None or math.isclose(x[c], y[c], rel_tol=tolerance, abs_tol=tolerance) or x[c] != x[c] and y[c] != y[c], (c, x, y)


def asks(n):
    v = F.col("close")
    return [rolled.Rolling(f"{k}_{n}", k, v, n) for k in rolled.KINDS] + [rolled.Rolling(f"volume_{n}", "stddev_samp", F.col("volume"), n)]


@pytest.mark.parametrize("n", [2, 7, 60, 200])
def test_blocks_equal_sliding_windows(history, n):
    columns = [a.out for a in asks(n)]
    close_rows(rolled.rolled(history, asks(n), short=1), rolled.rolled(history, asks(n), short=10**6), columns)


def test_blocks_keep_small_values_behind_a_huge_one(spark):
    values = [1.0, 2.0, 1e200, 3.0, 1.0, 1.0, 1.0, 1.0, 1.0, float("nan"), 4.0, 5.0, 6.0, 9.0, 5.0]
    frame = spark.createDataFrame([("A", i, v, v) for i, v in enumerate(values)], "ticker string, session_date int, close double, volume double")
    got = sorted(rolled.rolled(frame, asks(4), short=1).collect(), key=lambda r: r["session_date"])
    # A window of equal values has no deviation at all, right after the huge one left.
    assert [r["stddev_samp_4"] for r in got[7:9]] == [0.0, 0.0] and got[7]["slope_4"] == 0.0
    assert got[14]["avg_4"] == 6.25 and got[14]["min_4"] == 5.0 and math.isclose(got[14]["stddev_samp_4"], statistics.stdev([5, 6, 9, 5]))
    assert math.isnan(got[10]["avg_4"]) and math.isnan(got[10]["max_4"]) and got[10]["min_4"] == 1.0
    with pytest.raises(ValueError, match="unknown kinds"):
        rolled.rolled(frame, [rolled.Rolling("x", "mode", F.col("close"), 4)])


@pytest.mark.parametrize("rows", [64, 500])
def test_sliced_indicators_equal_those_by_ticker(history, rows):
    panel = history.where("close is not null")
    close_rows(technical.technical_features(panel, slice_rows=rows), technical.technical_features(panel), technical.COLUMNS)


def test_sliced_prices_look_back_and_ahead(history):
    columns = [c for c in prices.price_features(history).columns if c not in history.columns]
    a, b = prices.price_features(history, slice_rows=40), prices.price_features(history)
    assert a.columns == b.columns and {"target_return_5d", "volatility_60d", "log_return_20d"} <= set(columns)
    close_rows(a, b, columns)


def test_a_slice_sees_its_halo_and_nothing_else(history):
    seen = Window.partitionBy("ticker").orderBy("session_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    build = lambda f: f.withColumns({"n": F.count("*").over(seen), "first": F.min("_t").over(seen), "last": F.max("_t").over(seen)})
    rows = [r for r in sliced.sliced(history, build, back=30, ahead=7, rows=100).collect() if r["ticker"] == "LONG"]
    assert len(rows) == 1500 and {(r["first"], r["last"]) for r in rows} == {(max(0, 100 * i - 30), min(1499, 100 * i + 106)) for i in range(15)}
    with pytest.raises(ValueError, match="at least one row"):
        sliced.sliced(history, build, back=1, rows=0)


@pytest.mark.parametrize("time", [1.0, 37.0, 1e9])
def test_rows_are_numbered_as_by_one_window(history, time):
    a = {(r["ticker"], r["session_date"]): r["_t"] for r in sliced.row_numbers(history, time=time).collect()}
    b = {(r["ticker"], r["session_date"]): r["_t"] for r in numbered(history).collect()}
    assert a == b and len(a) == history.count()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "long", "double"])
def test_rows_are_numbered_by_any_clock_and_missing_times_come_first(spark, kind):
    made = F.timestamp_seconds(F.col("id") * 61) if "time" in kind else F.col("id") * 3
    frame = spark.range(200).select(F.lit("A").alias("ticker"), F.when(F.col("id") > 1, made.cast(kind)).alias("session_date"), "id")
    rows = sliced.row_numbers(frame, time=sliced.stretch(frame, 16)).collect()
    assert sorted(r["_t"] for r in rows) == list(range(200))
    assert all(r["_t"] == r["id"] for r in rows if r["id"] > 1)


def test_reach_lets_recursions_forget():
    assert technical.REACH >= 1000 and (13 / 14) ** sliced.settled(13 / 14) < 2.0**-56


# ------------------------------------------------------------------ medians


def series(spark, values, kind="int"):
    return spark.createDataFrame(list(enumerate(values)), f"session_date {kind}, x double").repartition(5)


def so_far(values):
    out, seen = [], []
    for v in values:
        if v is not None:
            seen.append(v)
        out.append((statistics.median(seen) if seen else None, len(seen)))
    return out


@pytest.mark.parametrize("name", ["random", "up", "down", "ties", "nulls", "steps"])
@pytest.mark.parametrize("blocks", [1, 5, 40])
def test_expanding_medians(spark, name, blocks):
    rng = random.Random(9)
    values = {
        "random": [rng.gauss(0, 1) for _ in range(700)],
        "up": [float(i) for i in range(300)],
        "down": [float(-i) for i in range(300)],
        "ties": [float(rng.randint(0, 2)) for _ in range(500)],
        "nulls": [None, None, *(rng.random() if rng.random() < 0.4 else None for _ in range(200)), *[None] * 60, 5.0],
        "steps": [float(i // 100 % 2 * 100) + rng.random() for i in range(600)],
    }[name]
    got = sorted(medians.expanding_median(series(spark, values), "x", blocks=blocks).collect(), key=lambda r: r["session_date"])
    assert [(r["_median"], r["_n"]) for r in got] == so_far(values)


def test_expanding_medians_of_nothing(spark):
    empty = series(spark, [1.0]).limit(0)
    assert medians.expanding_median(empty, "x").collect() == []
    got = medians.expanding_median(series(spark, [None, None, None]), "x", blocks=2).collect()
    assert [(r["_median"], r["_n"]) for r in got] == [(None, 0)] * 3


def test_regime_by_blocks_equals_the_growing_window(spark):
    rng, price, rows = random.Random(8), 100.0, []
    for i in range(900):
        price *= math.exp(rng.gauss(0, 0.03 if i // 150 % 2 else 0.005))
        rows.append((i, price))
    index = spark.createDataFrame(rows, "session_date int, close double")
    a = context.regime(context.index_features(index, slice_rows=100), blocks=16)
    b = context.regime(context.index_features(index))
    a, b = (sorted(x.collect(), key=lambda r: r["session_date"]) for x in (a, b))
    pick = lambda rows: [(r["session_date"], r["market_regime_trend"], r["market_regime_volatility"]) for r in rows]
    assert pick(a) == pick(b) and {1.0, 0.0, -1.0} == {r["market_regime_volatility"] for r in a}


# ------------------------------------------------------------------ selection


def test_ordered_bits_are_in_order_and_come_back():
    values = np.array([-np.inf, -1e300, -1.5, -1e-320, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf, np.nan])
    keys = selection.ordered_bits(values)
    assert (np.diff(keys.astype(object)) > 0).all() and selection.ordered_bits(np.array([-0.0]))[0] == keys[4]
    assert [selection.from_bits(int(k)) for k in keys[:-1]] == values[:-1].tolist() and math.isnan(selection.from_bits(int(keys[-1])))


def test_selected_quantiles_equal_percentile(spark):
    rng, rows = random.Random(6), []
    for i in range(4000):
        fold = rng.choice([1, 2, 2, 2, None])
        rows.append((fold, rng.choice(["a", "b"]), rng.gauss(0, 1) * 10 ** rng.randint(-200, 200), float(rng.randint(-1, 1)) * 0.0, None if fold == 1 or i % 3 else float(i % 7), float("nan") if i % 5 == 0 else -float(i)))
    frame = spark.createDataFrame(rows, "fold_id int, side string, f1 double, f2 double, f3 double, f4 double").repartition(6)
    features, shares = ["f1", "f2", "f3", "f4"], [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    want = {(r["fold_id"], r["side"]): r for r in frame.groupBy("fold_id", "side").agg(*(F.percentile(f, F.array(*map(F.lit, shares))).alias(f) for f in features)).collect()}
    got = dict(selection.exact_quantiles(frame, features, shares, keys=("fold_id", "side")))
    assert got.keys() == want.keys() and len(got) == 6
    for k, found in got.items():
        for f in features:
            a, b = found[f], want[k][f]
            assert (a is None) == (b is None) and (a is None or all(x == y or x != x and y != y for x, y in zip(a, b, strict=True))), (k, f, a, b)


def test_robust_scaling_is_the_same_either_way(spark):
    frame = spark.range(3000).select((F.col("id") % 3).cast("int").alias("fold_id"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("f"), F.lit(2.0).alias("g"), F.lit(None).cast("double").alias("h"))
    by = lambda n: sorted(map(tuple, scaling.fit_by(frame, ["f", "g", "h"], kind="robust", buffered_rows=n).collect()))
    assert by(0) == by(10**6) and by(0)[0][4] == 1.0
    assert scaling.fit_by(frame.limit(0), ["f"], kind="robust", buffered_rows=0).collect() == []
