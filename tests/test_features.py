import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from strandline.functions import context, prices, technical
from strandline.functions.recursive import smoothed
from tests.panels import SCHEMA, close_to, collected, frame, weekdays

FAMILIES = {
    "returns": (prices.return_features, ("log_return_1d", "log_return_20d", "intraday_return", "overnight_gap", "high_low_range")),
    "volatility": (prices.volatility_volume_features, ("volatility_5d", "volatility_60d", "volume_change_1d", "volume_sma_20d", "volume_zscore_5d")),
    "technical": (technical.technical_features, technical.COLUMNS),
}
WARM_UP = {"log_return_20d": 20, "volatility_5d": 5, "volatility_60d": 60, "volume_sma_20d": 19, "sma_200": 199, "ema_50": 49, "rsi_14": 14, "macd_12_26": 33, "macd_signal_9": 33}
WARM_UP |= {"stoch_k_14": 17, "stoch_d_14_3": 17, "plus_di_14": 14, "adx_14": 27, "bb_percent_b_20_2": 19, "trend_slope_50": 49, "overnight_gap": 1}


@pytest.mark.parametrize("family", FAMILIES)
def test_tickers_are_isolated_and_the_future_is_unseen(spark, family):
    build, columns = FAMILIES[family]
    both = collected(build(frame(spark, "AAA", "BBB")), *columns)
    alone = collected(build(frame(spark, "AAA")), *columns)
    day = weekdays(260)[210]
    later = F.col("session_date") > F.lit(day)
    changed = frame(spark, "AAA").withColumns({c: F.when(later, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    mutated = collected(build(changed), *columns)
    for key, values in alone.items():
        assert all(close_to(a, b) for a, b in zip(values, both[key], strict=True)), key
        if key[1] <= day:
            assert all(close_to(a, b) for a, b in zip(values, mutated[key], strict=True)), key


@pytest.mark.parametrize("family", FAMILIES)
def test_warm_up_is_exact(spark, family):
    build, columns = FAMILIES[family]
    rows = sorted(collected(build(frame(spark, "AAA")), *columns).items())
    for i, c in enumerate(columns):
        if c in WARM_UP:
            values = [v[i] for _, v in rows]
            assert all(v is None for v in values[: WARM_UP[c]]), c
            assert all(v is not None for v in values[WARM_UP[c] :]), c


def test_hand_values(spark):
    days = weekdays(4)
    closes = [110.0, 100.0, 125.0, 128.0]
    panel = spark.createDataFrame([("A", d, c - 1, c + 2, c - 3, c, c, 10.0) for d, c in zip(days, closes, strict=True)], SCHEMA)
    got = collected(prices.return_features(panel, (1, 2)), "log_return_1d", "log_return_2d", "intraday_return", "overnight_gap", "high_low_range")
    assert got["A", days[0]][:2] == (None, None)
    assert close_to(got["A", days[2]][0], math.log(125 / 100)) and close_to(got["A", days[3]][1], math.log(128 / 100))
    assert close_to(got["A", days[1]][3], math.log(99 / 110)) and close_to(got["A", days[1]][4], math.log(102 / 97))


def test_targets_by_hand_and_tail_nulls(spark):
    days = weekdays(6)
    adj = [100.0, 110.0, 99.0, 100.0, 120.0, 108.0]
    panel = spark.createDataFrame([("A", d, 1.0, 1.0, 1.0, 1.0, a, 1.0) for d, a in zip(days, adj, strict=True)], SCHEMA)
    got = collected(prices.targets(panel, (1, 3)), "target_return_1d", "target_up_1d", "target_return_3d", "target_up_3d")
    assert close_to(got["A", days[0]][0], math.log(1.1)) and got["A", days[0]][1] == 1.0
    assert got["A", days[0]][3] == 0.0  # an unchanged price is not up
    assert got["A", days[5]] == (None, None, None, None)
    assert sum(v[2] is None for v in got.values()) == 3


@pytest.mark.parametrize("bad", [(), (0,), (True,), (1, 1), (1.5,)])
def test_counts_are_checked(spark, bad):
    with pytest.raises(ValueError):
        prices.return_features(frame(spark, "A", n=3), bad)


def loop(xs, rho, c, start, seed):
    out = [None] * len(xs)
    for t in range(start, len(xs)):
        out[t] = seed if t == start else rho * out[t - 1] + c * xs[t]
    return out


def test_recursion_equals_a_loop_over_long_histories(spark):
    n, rho = 5000, 1 - 2 / 11
    xs = [100 + 20 * math.sin(i / 9) for i in range(n)]
    rows = spark.createDataFrame([("A", i, x) for i, x in enumerate(xs)], "ticker string, _t int, x double")
    got = {r["_t"]: r["y"] for r in smoothed(rows, "y", F.col("x"), rho=rho, c=1 - rho, start=9, seed=F.lit(50.0)).collect()}
    want = loop(xs, rho, 1 - rho, 9, 50.0)
    assert all(close_to(got[t], want[t], 1e-12) for t in range(n))


def test_indicators_equal_textbook_loops(spark):
    got = collected(technical.technical_features(frame(spark, "AAA")), "close", "rsi_14", "ema_20", "adx_14", "high", "low")
    rows = [v for _, v in sorted(got.items())]
    close = [r[0] for r in rows]
    change = [None] + [b - a for a, b in zip(close, close[1:], strict=False)]
    up, down = [max(x, 0) if x is not None else None for x in change], [max(-x, 0) if x is not None else None for x in change]
    g, d = loop(up, 13 / 14, 1 / 14, 14, sum(up[1:15]) / 14), loop(down, 13 / 14, 1 / 14, 14, sum(down[1:15]) / 14)
    e = loop(close, 19 / 21, 2 / 21, 19, sum(close[:20]) / 20)
    for t in range(40, 260):
        assert close_to(rows[t][1], 100 * g[t] / (g[t] + d[t]), 1e-9) and close_to(rows[t][2], e[t], 1e-9)
    assert all(0 <= r[3] <= 100 for r in rows[27:])


def test_flat_prices_have_defined_values(spark):
    panel = spark.createDataFrame([("A", d, 5.0, 5.0, 5.0, 5.0, 5.0, 7.0) for d in weekdays(60)], SCHEMA)
    got = collected(technical.technical_features(prices.volatility_volume_features(panel)), "rsi_14", "stoch_k_14", "adx_14", "bb_percent_b_20_2", "volume_zscore_5d")
    assert got["A", weekdays(60)[-1]] == (0.0, 0.0, 0.0, None, None)


def test_empty_panel_keeps_all_columns(spark):
    out = technical.technical_features(prices.targets(prices.volatility_volume_features(prices.return_features(frame(spark, "A", n=2).limit(0)))))
    assert out.count() == 0 and set(technical.COLUMNS) <= set(out.columns)


def _stocks(spark, n=80):
    return frame(spark, "A", "B", "C", n=n).withColumn("sector", F.when(F.col("ticker") == "C", "BANK").otherwise("IT"))


def _index(spark, n=80, days=None):
    return spark.createDataFrame([(d, 1000 + 1.5 * i) for i, d in enumerate(days or weekdays(n))], "session_date date, close double")


def test_context_columns_and_helpers(spark):
    market = context.market_context(_stocks(spark), market_index=_index(spark))
    assert "stock_return_1d_context" in market.columns
    assert "stock_return_1d_context" not in context.sector_context(_stocks(spark)).columns
    everything = context.context_features(_stocks(spark), market_index=_index(spark))
    assert set(context.ALL_COLUMNS) <= set(everything.columns)
    last = everything.where(F.col("session_date") == F.lit(weekdays(80)[-1])).first()
    assert last["india_vix"] is None and last["market_regime_trend"] in (-1.0, 0.0, 1.0)
    first = everything.where(F.col("session_date") == F.lit(weekdays(80)[0])).first()
    assert first["market_breadth_1d"] == 0.0  # missing returns count as not up
    assert first["market_regime_volatility"] == 0.0


def test_context_sees_no_future(spark):
    day = weekdays(80)[60]
    base = context.context_features(_stocks(spark), market_index=_index(spark))
    index = _index(spark).withColumn("close", F.when(F.col("session_date") > F.lit(day), F.col("close") * 2).otherwise(F.col("close")))
    stocks = _stocks(spark).withColumn("close", F.when(F.col("session_date") > F.lit(day), F.col("close") / 2).otherwise(F.col("close")))
    columns = [c for c in context.ALL_COLUMNS if not c.startswith(("india", "usd", "crude"))]
    a, b = collected(base, *columns), collected(context.context_features(stocks, market_index=index), *columns)
    for key in a:
        if key[1] <= day:
            assert all(close_to(x, y) for x, y in zip(a[key], b[key], strict=True)), key


def test_repeated_index_days_are_refused(spark):
    index = _index(spark).unionByName(_index(spark).limit(1))
    with pytest.raises(Exception, match="repeated keys"):
        context.cross_asset_context(_stocks(spark), crude=index).collect()


def test_missing_index_days_give_null(spark):
    days = weekdays(80)
    out = context.cross_asset_context(_stocks(spark), crude=_index(spark, days=days[:40]))
    got = out.where(F.col("session_date") == F.lit(days[50])).first()
    assert got["crude_return_1d"] is None and got["session_date"] - timedelta(days=0) == days[50]
