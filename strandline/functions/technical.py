"""Technical indicators, per ticker, from past rows only.

Definitions are the published ones (simple and exponential means, Wilder's RSI
and directional movement, Bollinger bands on the population deviation, slow
stochastic of simple means, least-squares slope).  Each family is a function of
its own; ``technical_features`` chains them over one exchange by ticker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.recursive import BY_ROW, ema, numbered, recursions, wilder_mean, wilder_sum
from strandline.functions.rolled import Rolling, rolled
from strandline.functions.sliced import settled, sliced
from strandline.functions.windows import BY_DAY, over, required, rolling

SMA_WINDOWS = (10, 20, 50, 200)
SLOPE_WINDOWS = (20, 50)
EMA_SPANS = (10, 20, 50)

COLUMNS = (
    *(f"sma_{n}" for n in SMA_WINDOWS),
    *(f"ema_{n}" for n in EMA_SPANS),
    *(f"close_to_sma_{n}" for n in SMA_WINDOWS),
    "rsi_14",
    *("macd_12_26", "macd_signal_9", "macd_hist_12_26_9"),
    *("stoch_k_14", "stoch_d_14_3"),
    *("adx_14", "plus_di_14", "minus_di_14", "di_spread_14"),
    *("bb_percent_b_20_2", "bb_bandwidth_20_2"),
    *("trend_slope_20", "trend_slope_50"),
)


def _by_row(family: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A family over numbered rows: ``order`` says that the caller has numbered them."""

    @wraps(family)
    def run(panel: DataFrame, *args, order: tuple[str, ...] | None = None, **options) -> DataFrame:
        if order is not None:
            return family(panel, *args, order=order, **options)
        return family(numbered(panel), *args, order=BY_ROW, **options).drop(*BY_ROW)

    return run


def _means(windows: tuple[int, ...]) -> list[Rolling]:
    return [Rolling(f"sma_{n}", "avg", F.col("close"), n) for n in windows]


def _ratios(panel: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    return panel.withColumns({f"close_to_sma_{n}": F.try_divide(F.col("close"), F.col(f"sma_{n}")) - 1 for n in windows})


def _slopes(windows: tuple[int, ...]) -> list[Rolling]:
    return [Rolling(f"trend_slope_{n}", "slope", F.col("close"), n) for n in windows]


def moving_averages(panel: DataFrame, windows: tuple[int, ...] = SMA_WINDOWS, *, order: tuple[str, ...] = BY_DAY) -> DataFrame:
    """sma_{n} and close_to_sma_{n} = close / sma - 1."""
    return _ratios(rolled(panel, _means(windows), order=order), windows)


@_by_row
def exponential_averages(panel: DataFrame, spans: tuple[int, ...] = EMA_SPANS, *, order: tuple[str, ...]) -> DataFrame:
    return recursions(panel, [ema(f"ema_{n}", F.col("close"), n) for n in spans])


@_by_row
def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *, order: tuple[str, ...]) -> DataFrame:
    """Both means are seeded at the slow one's first row; all three lines start with the signal."""
    start = slow - 1
    out = recursions(panel, [ema("_fast", F.col("close"), fast, start=start), ema("_slow", F.col("close"), slow)])
    out = out.withColumn("_macd", F.col("_fast") - F.col("_slow"))
    out = recursions(out, [ema("_signal", F.col("_macd"), signal, start=start + signal - 1)])
    shown = F.col("_t") >= start + signal - 1
    out = out.withColumns({f"macd_{fast}_{slow}": F.when(shown, F.col("_macd")), f"macd_signal_{signal}": F.col("_signal"), f"macd_hist_{fast}_{slow}_{signal}": F.col("_macd") - F.col("_signal")})
    return out.drop("_fast", "_slow", "_macd", "_signal")


@_by_row
def rsi(panel: DataFrame, n: int = 14, *, order: tuple[str, ...]) -> DataFrame:
    """100 * gains / (gains + losses) of Wilder means, 0 where both are 0."""
    out = panel.withColumn("_d", F.col("close") - F.lag("close", 1).over(over(order=order)))
    up, down = F.greatest(F.col("_d"), F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
    out = recursions(out, [wilder_mean("_g", up, n, start=n), wilder_mean("_l", down, n, start=n)])
    total = F.col("_g") + F.col("_l")
    return out.withColumn(f"rsi_{n}", F.when(total > 0, 100 * F.col("_g") / total).when(total.isNotNull(), 0.0)).drop("_d", "_g", "_l")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100 * part / whole).when(whole.isNotNull(), 0.0)


@_by_row
def directional_movement(panel: DataFrame, n: int = 14, *, order: tuple[str, ...]) -> DataFrame:
    """Wilder's +DI, -DI (from row n), their spread, and ADX (from row 2n - 1)."""
    w = over(order=order)
    up, down = F.col("high") - F.lag("high", 1).over(w), F.lag("low", 1).over(w) - F.col("low")
    before = F.lag("close", 1).over(w)
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    out = panel.withColumns({"_u": up, "_d": down, "_tr": F.when(before.isNotNull(), reach)})
    plus = F.when((F.col("_u") > F.col("_d")) & (F.col("_u") > 0), F.col("_u")).when(F.col("_u").isNotNull(), 0.0)
    minus = F.when((F.col("_d") > F.col("_u")) & (F.col("_d") > 0), F.col("_d")).when(F.col("_d").isNotNull(), 0.0)
    out = recursions(out, [wilder_sum(name, x, n) for name, x in (("_sp", plus), ("_sm", minus), ("_st", F.col("_tr")))])
    shown = F.col("_t") >= n
    out = out.withColumns({f"plus_di_{n}": F.when(shown, _share(F.col("_sp"), F.col("_st"))), f"minus_di_{n}": F.when(shown, _share(F.col("_sm"), F.col("_st")))})
    plus, minus = F.col(f"plus_di_{n}"), F.col(f"minus_di_{n}")
    out = out.withColumns({f"di_spread_{n}": plus - minus, "_dx": _share(F.abs(plus - minus), plus + minus)})
    out = recursions(out, [wilder_mean(f"adx_{n}", F.col("_dx"), n, start=2 * n - 1)])
    return out.drop("_u", "_d", "_tr", "_sp", "_sm", "_st", "_dx")


def bollinger(panel: DataFrame, n: int = 20, width: float = 2.0, *, order: tuple[str, ...] = BY_DAY) -> DataFrame:
    """Place within the band and the band's width over its middle."""
    out = panel.withColumns({"_mid": rolling("avg", F.col("close"), n, order=order), "_dev": rolling("stddev_pop", F.col("close"), n, order=order)})
    half = F.lit(width) * F.col("_dev")
    name = f"{n}_{width:g}"
    return out.withColumns({f"bb_percent_b_{name}": F.try_divide(F.col("close") - (F.col("_mid") - half), 2 * half), f"bb_bandwidth_{name}": F.try_divide(2 * half, F.col("_mid"))}).drop("_mid", "_dev")


def stochastic(panel: DataFrame, fast: int = 14, k: int = 3, d: int = 3, *, order: tuple[str, ...] = BY_DAY) -> DataFrame:
    """Slow stochastic; a flat range counts as 0, and both lines start together."""
    out = panel.withColumns({"_lo": rolling("min", F.col("low"), fast, order=order), "_hi": rolling("max", F.col("high"), fast, order=order)})
    reach = F.col("_hi") - F.col("_lo")
    out = out.withColumn("_f", F.when(reach > 0, 100 * (F.col("close") - F.col("_lo")) / reach).when(reach.isNotNull(), 0.0))
    out = out.withColumn("_k", rolling("avg", F.col("_f"), k, order=order))
    out = out.withColumn(f"stoch_d_{fast}_{d}", rolling("avg", F.col("_k"), d, order=order))
    return out.withColumn(f"stoch_k_{fast}", F.when(F.col(f"stoch_d_{fast}_{d}").isNotNull(), F.col("_k"))).drop("_lo", "_hi", "_f", "_k")


@_by_row
def trend_slope(panel: DataFrame, windows: tuple[int, ...] = SLOPE_WINDOWS, *, order: tuple[str, ...]) -> DataFrame:
    """Least-squares slope of close against the row's number."""
    return rolled(panel, _slopes(windows), order=order)


def _all_by_row(numbered_panel: DataFrame) -> DataFrame:
    """All of ``COLUMNS`` over numbered rows; means and slopes of one window share its blocks."""
    out = _ratios(rolled(numbered_panel, [*_means(SMA_WINDOWS), *_slopes(SLOPE_WINDOWS)], order=BY_ROW), SMA_WINDOWS)
    for family in (bollinger, stochastic, exponential_averages, rsi, macd, directional_movement):
        out = family(out, order=BY_ROW)
    return out


#: Rows that any of ``COLUMNS`` looks back: the longest window, or until a recursion has forgotten its start.
REACH = max(*SMA_WINDOWS, *SLOPE_WINDOWS, settled(1 - 2 / (max(EMA_SPANS) + 1)), settled(1 - 2 / 27, 1 - 2 / 10), 1 + settled(1 - 1 / 14, 1 - 1 / 14))


def technical_features(panel: DataFrame, *, slice_rows: int | None = None) -> DataFrame:
    """``panel`` with all of ``COLUMNS``: rows are numbered once, and every family reads them in
    that order, so there is one exchange.

    With ``slice_rows`` a ticker's history is cut into slices of so many rows, so that the work is not one
    task a ticker: for few tickers or long ones.  Slices much longer than ``REACH`` repeat little.
    """
    required(panel, ("ticker", "session_date", "open", "high", "low", "close"))
    out = sliced(panel, _all_by_row, back=REACH, rows=slice_rows) if slice_rows else _all_by_row(numbered(panel))
    return out.select(*(c for c in panel.columns if c not in COLUMNS), *COLUMNS)
