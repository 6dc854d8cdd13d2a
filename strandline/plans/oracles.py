"""The same queries as DuckDB SQL, written from their definitions."""

from __future__ import annotations

BARS = """trades AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS session_date, l_extendedprice / l_quantity AS px, l_quantity,
    row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS a,
    row_number() OVER (PARTITION BY p_brand, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS z
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS MATERIALIZED (
  SELECT ticker, session_date, max(CASE WHEN a = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
    max(CASE WHEN z = 1 THEN px END) AS close, max(CASE WHEN z = 1 THEN px END) AS adj_close, sum(l_quantity) AS volume
  FROM trades GROUP BY 1, 2)"""

W = "OVER (PARTITION BY ticker ORDER BY session_date)"


def last(n: int, by: str = "PARTITION BY ticker") -> str:
    return f"OVER ({by} ORDER BY session_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def gated(fn: str, x: str, n: int, by: str = "PARTITION BY ticker") -> str:
    return f"CASE WHEN count({x}) {last(n, by)} >= {n} THEN {fn}({x}) {last(n, by)} END"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {name}"


def keyed(select: str, *ctes: str, source: str = "bars") -> str:
    return f"WITH {', '.join([BARS, *ctes])} SELECT ticker, session_date, {select} FROM {source}"


def ret(h: int, x: str = "close") -> str:
    return f"ln({x} / lag({x}, {h}) {W})"


VOL = f"ret AS (SELECT *, {ret(1)} AS r FROM bars)"


def smooth(name: str, source: str, out: str, x: str, rho: str, c: str, start: int, seed: str) -> str:
    """A recursion as one running sum (short histories only)."""
    return (
        f"{name} AS (SELECT * EXCLUDE (seed), CASE WHEN t >= {start} THEN pow({rho}, t - {start}) * sum(CASE WHEN t = {start} THEN seed WHEN t > {start} THEN {c} * {x} * pow({rho}, {start} - t) END) "
        f"OVER (PARTITION BY ticker ORDER BY t) END AS {out} FROM (SELECT *, {seed} AS seed FROM {source}))"
    )


def mean_until(x: str, n: int) -> str:
    return f"avg({x}) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ema(name: str, source: str, out: str, x: str, n: int, start: int) -> str:
    return smooth(name, source, out, x, f"(1 - 2.0::DOUBLE / {n + 1})", f"(2.0::DOUBLE / {n + 1})", start, mean_until(x, n))


def wilder(name: str, source: str, out: str, x: str, n: int, start: int) -> str:
    return smooth(name, source, out, x, f"(1 - 1.0::DOUBLE / {n})", f"(1.0::DOUBLE / {n})", start, mean_until(x, n))


def wilder_sum(name: str, source: str, out: str, x: str, n: int) -> str:
    return smooth(name, source, out, x, f"(1 - 1.0::DOUBLE / {n})", "1.0::DOUBLE", n - 1, f"{n - 1} * {mean_until(x, n - 1)}")


NUM = f"num AS (SELECT *, row_number() {W} - 1 AS t FROM bars)"

EMA = [NUM, ema("e10", "num", "ema_10", "close", 10, 9), ema("e20", "e10", "ema_20", "close", 20, 19), ema("e50", "e20", "ema_50", "close", 50, 49)]
MACD = [
    NUM,
    ema("f1", "num", "fast", "close", 12, 25),
    ema("f2", "f1", "slow", "close", 26, 25),
    "f3 AS (SELECT *, fast - slow AS m FROM f2)",
    ema("f4", "f3", "sig", "m", 9, 33),
]
MACD_OUT = {"macd_12_26": "CASE WHEN t >= 33 THEN m END", "macd_signal_9": "sig", "macd_hist_12_26_9": "m - sig"}
RSI = [
    NUM,
    f"g0 AS (SELECT *, close - lag(close) {W} AS d FROM num)",
    "g1 AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM g0)",
    wilder("g2", "g1", "g", "up", 14, 14),
    wilder("g3", "g2", "l", "down", 14, 14),
]
RSI_OUT = "CASE WHEN g + l > 0 THEN 100 * g / (g + l) WHEN g IS NOT NULL THEN 0 END"
DMI = [
    NUM,
    f"""h0 AS (SELECT *, high - lag(high) {W} AS u, lag(low) {W} - low AS d,
      CASE WHEN lag(close) {W} IS NOT NULL THEN greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) END AS tr FROM num)""",
    "h1 AS (SELECT *, CASE WHEN u > d AND u > 0 THEN u WHEN u IS NOT NULL THEN 0 END AS p, CASE WHEN d > u AND d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS m FROM h0)",
    wilder_sum("h2", "h1", "sp", "p", 14),
    wilder_sum("h3", "h2", "sm", "m", 14),
    wilder_sum("h4", "h3", "st", "tr", 14),
    "h5 AS (SELECT *, CASE WHEN t >= 14 THEN CASE WHEN st > 0 THEN 100 * sp / st WHEN st IS NOT NULL THEN 0 END END AS pdi, CASE WHEN t >= 14 THEN CASE WHEN st > 0 THEN 100 * sm / st WHEN st IS NOT NULL THEN 0 END END AS mdi FROM h4)",
    "h6 AS (SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) WHEN pdi IS NOT NULL THEN 0 END AS dx FROM h5)",
    wilder("h7", "h6", "adx", "dx", 14, 27),
]
DMI_OUT = {"plus_di_14": "pdi", "minus_di_14": "mdi", "di_spread_14": "pdi - mdi", "adx_14": "adx"}
BB = [f"bb AS (SELECT *, {gated('avg', 'close', 20)} AS mid, {gated('stddev_pop', 'close', 20)} AS dev FROM bars)"]
BB_OUT = {"bb_percent_b_20_2": "(close - (mid - 2 * dev)) / nullif(4 * dev, 0)", "bb_bandwidth_20_2": "4 * dev / nullif(mid, 0)"}
STOCH = [
    f"k0 AS (SELECT *, {gated('min', 'low', 14)} AS lo, {gated('max', 'high', 14)} AS hi FROM bars)",
    "k1 AS (SELECT *, CASE WHEN hi - lo > 0 THEN 100 * (close - lo) / (hi - lo) WHEN hi IS NOT NULL THEN 0 END AS f FROM k0)",
    f"k2 AS (SELECT *, {gated('avg', 'f', 3)} AS k FROM k1)",
    f"k3 AS (SELECT *, {gated('avg', 'k', 3)} AS d FROM k2)",
]
STOCH_OUT = {"stoch_k_14": "CASE WHEN d IS NOT NULL THEN k END", "stoch_d_14_3": "d"}
SMA_OUT = {**{f"sma_{n}": gated("avg", "close", n) for n in (10, 20, 50, 200)}, **{f"close_to_sma_{n}": f"close / ({gated('avg', 'close', n)}) - 1" for n in (10, 20, 50, 200)}}
SLOPE_OUT = {f"trend_slope_{n}": f"CASE WHEN count(close) {last(n)} >= {n} THEN regr_slope(close, t) {last(n)} END" for n in (20, 50)}


def cols(out: dict[str, str]) -> str:
    return ", ".join(r(x, name) for name, x in out.items())


def index_series(name: str = "mi", where: str = "") -> str:
    return f"{name} AS (SELECT CAST(o_orderdate AS DATE) AS session_date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 370.0::DOUBLE AS close FROM orders {where} GROUP BY 1)"


I = "OVER (ORDER BY session_date)"
INDEX = [
    index_series(),
    f"i1 AS (SELECT *, ln(close / lag(close, 1) {I}) AS r1, ln(close / lag(close, 5) {I}) AS r5, ln(close / lag(close, 20) {I}) AS r20, {gated('avg', 'close', 20, '')} AS s20, {gated('avg', 'close', 50, '')} AS s50 FROM mi)",
    f"i2 AS (SELECT *, {gated('stddev_samp', 'r1', 20, '')} AS v, close / s20 - 1 AS c20, close / s50 - 1 AS c50 FROM i1)",
    "i3 AS (SELECT *, count(v) OVER (ORDER BY session_date ROWS UNBOUNDED PRECEDING) AS nv, quantile_cont(v, 0.5) OVER (ORDER BY session_date ROWS UNBOUNDED PRECEDING) AS med FROM i2)",
    """i4 AS (SELECT *, CASE WHEN c50 > 0.02 THEN 1.0 WHEN c50 < -0.02 THEN -1.0 ELSE 0.0 END AS trend,
      CASE WHEN nv >= 60 AND v > med * 1.5 THEN 1.0 WHEN nv >= 60 AND v < med * 0.75 THEN -1.0 ELSE 0.0 END AS vol FROM i3)""",
]
OWN = f"own AS (SELECT *, 'S' || (CAST(regexp_extract(ticker, '(\\d+)', 1) AS INTEGER) % 5) AS sector, {ret(1)} AS q1, {ret(5)} AS q5, {ret(20)} AS q20 FROM bars)"
BREADTH = "br AS (SELECT session_date, avg(CASE WHEN q1 > 0 THEN 1.0 ELSE 0.0 END) AS b1, avg(CASE WHEN q5 > 0 THEN 1.0 ELSE 0.0 END) AS b5 FROM own GROUP BY 1)"
MARKET_OUT = {
    **{f"market_return_{n}d": f"i.r{n}" for n in (1, 5, 20)},
    "market_volatility_20d": "i.v", "market_sma_20": "i.s20", "market_sma_50": "i.s50", "market_close_to_sma_20": "i.c20", "market_close_to_sma_50": "i.c50",
    **{f"stock_vs_market_return_{n}d": f"q{n} - i.r{n}" for n in (1, 5, 20)},
    "market_breadth_1d": "b1", "market_breadth_5d": "b5",
}
SECTOR = [
    "s0 AS (SELECT sector, session_date, avg(q1) AS a1, avg(q5) AS a5, avg(q20) AS a20, avg(CASE WHEN q1 > 0 THEN 1.0 ELSE 0.0 END) AS sb FROM own GROUP BY 1, 2)",
    f"s1 AS (SELECT *, {gated('stddev_samp', 'a1', 20, 'PARTITION BY sector')} AS sv FROM s0)",
]
SECTOR_OUT = {**{f"sector_return_{n}d": f"a{n}" for n in (1, 5, 20)}, "sector_volatility_20d": "sv", **{f"stock_vs_sector_return_{n}d": f"q{n} - a{n}" for n in (1, 5, 20)}, "sector_breadth_1d": "sb"}
CROSS = [
    index_series("x1", "WHERE o_orderpriority = '1-URGENT'"), index_series("x2", "WHERE o_orderpriority = '2-HIGH'"), index_series("x3", "WHERE o_orderpriority = '5-LOW'"),
    f"y1 AS (SELECT session_date, close AS vix, close / lag(close) {I} - 1 AS dv FROM x1)", f"y2 AS (SELECT session_date, ln(close / lag(close) {I}) AS fx FROM x2)", f"y3 AS (SELECT session_date, ln(close / lag(close) {I}) AS oil FROM x3)",
]
CROSS_OUT = {"india_vix": "vix", "india_vix_change_1d": "dv", "usd_inr_return_1d": "fx"}

CLEAN = f"""c0 AS (SELECT *, {ret(1)} AS log_return_1d, ln(volume / lag(volume) {W}) AS volume_change_1d, close / ({gated('avg', 'close', 20)}) - 1 AS close_to_sma_20,
    ln(lead(adj_close, 1) {W} / adj_close) AS target_return_1d, ln(lead(adj_close, 5) {W} / adj_close) AS target_return_5d FROM bars),
c1 AS (SELECT ticker, session_date, log_return_1d, {gated('stddev_samp', 'log_return_1d', 20)} AS volatility_20d, volume_change_1d, close_to_sma_20, target_return_1d, target_return_5d,
    CASE WHEN target_return_1d > 0 THEN 1.0 WHEN target_return_1d IS NOT NULL THEN 0.0 END AS target_up_1d, CASE WHEN target_return_5d > 0 THEN 1.0 WHEN target_return_5d IS NOT NULL THEN 0.0 END AS target_up_5d FROM c0),
clean AS MATERIALIZED (SELECT * FROM c1 WHERE volatility_20d IS NOT NULL AND volume_change_1d IS NOT NULL AND close_to_sma_20 IS NOT NULL AND target_return_1d IS NOT NULL AND target_return_5d IS NOT NULL),
cal AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS si FROM (SELECT DISTINCT session_date FROM clean)),
n AS (SELECT count(*) AS n FROM cal),
rows0 AS (SELECT clean.*, si FROM clean JOIN cal USING (session_date))"""


def roles(folds: str, horizon: int) -> list[str]:
    """``folds`` makes (fold_id, role, lo, hi, out_lo, out_hi, lim), hi and out_hi inclusive."""
    return [
        CLEAN,
        f"folds AS ({folds})",
        "ra AS (SELECT rows0.*, fold_id, role, lim, si BETWEEN out_lo AND out_hi AS gone FROM rows0 JOIN folds ON si BETWEEN lo AND hi)",
        f"rb AS (SELECT *, lead(si, {horizon}) OVER (PARTITION BY ticker, fold_id, role, gone ORDER BY si) AS label FROM ra)",
        "roles AS MATERIALIZED (SELECT *, CASE WHEN gone THEN 'embargoed' WHEN lim IS NOT NULL AND (label IS NULL OR label >= lim) THEN 'purged' ELSE 'kept' END AS status FROM rb)",
    ]


def walk(train: int, val: int, step: int, embargo: int = 0, expanding: bool = True) -> str:
    begin = "0" if expanding else f"e - {train}"
    out = f"CASE WHEN f > 0 THEN e - {step} + {val} ELSE -1 END AS out_lo, CASE WHEN f > 0 THEN e - {step} + {val + embargo} - 1 ELSE -1 END AS out_hi" if embargo else "-1 AS out_lo, -1 AS out_hi"
    base = f"(SELECT f, {train} + f * {step} AS e, n FROM n, (SELECT unnest(range(0, 50)) AS f) WHERE {train} + f * {step} + {val} <= n)"
    return (
        f"SELECT CAST(f AS INTEGER) AS fold_id, 'train' AS role, {begin} AS lo, e - 1 AS hi, {out}, e AS lim FROM {base} UNION ALL "
        f"SELECT CAST(f AS INTEGER), 'val', e, e + {val} - 1, -1, -1, CASE WHEN e + {val} < n THEN e + {val} END FROM {base}"
    )


CHRONO = """SELECT 0 AS fold_id, 'train' AS role, 0 AS lo, a - 1 AS hi, -1 AS out_lo, -1 AS out_hi, a AS lim FROM (SELECT CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS a FROM n)
UNION ALL SELECT 0, 'val', a, a + b - 1, -1, -1, a + b FROM (SELECT CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS b FROM n)
UNION ALL SELECT 0, 'test', a + b, n - 1, a + b, a + b + 2, NULL FROM (SELECT n, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS b FROM n)"""
INNER = """SELECT 1 AS fold_id, 'train' AS role, 0 AS lo, e - s - 1 AS hi, -1 AS out_lo, -1 AS out_hi, e - s AS lim FROM z UNION ALL SELECT 1, 'val', e - s, e - 1, -1, -1, NULL FROM z
UNION ALL SELECT 2, 'train', 0, n - s - 1, -1, -1, n - s FROM z UNION ALL SELECT 2, 'val', n - s, n - 1, -1, -1, NULL FROM z"""
COUNTS = """SELECT fold_id, role, count(*) AS n_raw, count(*) FILTER (status = 'kept') AS n_kept, count(*) FILTER (status = 'purged') AS n_purged, count(*) FILTER (status = 'embargoed') AS n_embargoed,
  min(session_date) AS first_date, max(session_date) AS last_date FROM roles GROUP BY 1, 2"""
ROLES = roles(walk(1000, 400, 400), 5)
FEATURES = ("log_return_1d", "volatility_20d", "volume_change_1d", "close_to_sma_20")
PRED = "pred AS (SELECT ticker, session_date, fold_id, target_return_5d AS y, log_return_1d * -0.1::DOUBLE AS p, target_up_5d AS up, 1 / (1 + exp(log_return_1d * 2)) AS p1 FROM roles WHERE status = 'kept' AND role = 'val')"


def regression(source: str, keys: str) -> str:
    return f"""m0 AS (SELECT {keys}, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, sqrt(avg(y * y)) AS base, avg((y - p) * (y - p)) AS mse, var_pop(y) AS v,
  avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END) AS directional_accuracy, covar_pop(y, p) AS cv, stddev_pop(y) AS sy, stddev_pop(p) AS sp FROM {source} GROUP BY ALL),
m AS (SELECT {keys}, n, rmse, mae, CASE WHEN base > 1e-12 THEN rmse / base END AS relative_rmse, CASE WHEN v * n <= 1e-12 THEN 0.0 ELSE 1 - mse / v END AS r2, directional_accuracy,
  CASE WHEN sy <= 1e-12 OR sp <= 1e-12 THEN 0.0 ELSE cv / (sy * sp) END AS pearson_ic FROM m0)"""


METRICS = ("rmse", "mae", "relative_rmse", "r2", "directional_accuracy", "pearson_ic")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join([BARS, *ctes]) + " "


PRICE = ("open", "high", "low", "close", "adj_close")
NUMERIC = (*PRICE, "volume")
FAULTY = """f0 AS (SELECT CASE WHEN day(session_date) = 21 AND ticker = 'Brand#11' THEN '  ' ELSE ticker END AS ticker, session_date,
  CASE WHEN day(session_date) = 15 THEN 'inf'::DOUBLE ELSE open END AS open, high, CASE WHEN day(session_date) = 13 THEN high + 1 ELSE low END AS low, close,
  CASE WHEN day(session_date) = 9 THEN 0.0 WHEN day(session_date) = 10 THEN NULL ELSE adj_close END AS adj_close, CASE WHEN day(session_date) = 7 THEN -volume ELSE volume END AS volume FROM bars),
f AS (SELECT * FROM f0 UNION ALL SELECT * FROM f0 WHERE day(session_date) = 28)"""
QUALITY = ", ".join(
    [
        "count(*) AS n_rows", "count(*) FILTER (session_date IS NULL) AS bad_date", "count(*) FILTER (ticker IS NULL) AS null_ticker", "count(*) FILTER (trim(ticker) = '') AS blank_ticker",
        *(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in NUMERIC), *(f"count(*) FILTER (abs({c}) = 'inf'::DOUBLE) AS infinite_{c}" for c in NUMERIC),
        *(f"count(*) FILTER ({c} <= 0) AS non_positive_{c}" for c in PRICE), "count(*) FILTER (volume < 0) AS negative_volume",
        "count(*) FILTER (low > high OR open < low OR open > high OR close < low OR close > high) AS ohlc_relation",
        "(SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM f GROUP BY ticker, session_date HAVING count(*) > 1)) AS duplicate_keys",
    ]
)
AUDIT = """a AS (SELECT ticker, count(*) AS n_rows, min(session_date) AS first_date, max(session_date) AS last_date, count(DISTINCT session_date) AS n_dates, count(*) - count(DISTINCT session_date) AS duplicate_rows,
  CAST(0 AS BIGINT) AS missing_values, min(close) AS min_close, max(close) AS max_close, min(volume) AS min_volume, max(volume) AS max_volume FROM bars GROUP BY 1)"""

IDS = "ids AS (SELECT ticker, session_date, row_number() OVER (ORDER BY session_date, ticker) - 1 AS row_id FROM clean)"
SCALE = "fit AS (SELECT fold_id, " + ", ".join(f"avg({f}) AS {f}_c, stddev_pop({f}) AS {f}_s" for f in FEATURES) + " FROM roles WHERE status = 'kept' AND role = 'train' GROUP BY 1)"
#: The training rows of each fold on a calendar of their own, and parts of them (z: fold_id, inner_fold, lo, hi).
TRAINED = """tr AS (SELECT fold_id, ticker, session_date, dense_rank() OVER (PARTITION BY fold_id ORDER BY session_date) - 1 AS ti FROM roles WHERE status = 'kept' AND role = 'train'),
tn AS (SELECT fold_id, max(ti) + 1 AS n FROM tr GROUP BY 1)"""
INSIDE = ["ip AS (SELECT tr.*, inner_fold, lo, CASE WHEN ti < lo THEN 'fit' ELSE 'held' END AS part FROM tr JOIN z USING (fold_id) WHERE ti < hi)", "inside AS (SELECT *, lead(ti, 5) OVER (PARTITION BY fold_id, inner_fold, part, ticker ORDER BY ti) AS label FROM ip)"]

_SQL: dict[str, str] = {
    "panel_summary": with_(VOL, f"v AS (SELECT *, {gated('stddev_samp', 'r', 20)} AS v FROM ret)")
    + "SELECT ticker, count(*) AS n_sessions, count(v) AS n_volatility, round(avg(r), 6) AS mean_return, round(avg(v), 6) AS mean_volatility, max(high) AS top, sum(volume) AS volume FROM v GROUP BY 1",
    "bars": with_() + "SELECT * FROM bars",
    "quality_report": with_(FAULTY) + f"SELECT {QUALITY} FROM f",
    "order_report": with_("""o AS (SELECT ticker, session_date, lag(session_date) OVER (PARTITION BY ticker ORDER BY CASE WHEN CAST(regexp_extract(ticker, '(\\d+)', 1) AS INTEGER) % 2 = 1 THEN -1 ELSE 1 END * date_diff('day', DATE '1970-01-01', session_date)) AS before FROM bars)""")
    + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS duplicate_keys, count(DISTINCT CASE WHEN before > session_date THEN ticker END) AS unordered_tickers FROM o",
    "repeated_keys": "SELECT l_partkey, l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "context_returns": with_(OWN) + f"SELECT ticker, session_date, {cols({f'stock_return_{n}d_context': f'q{n}' for n in (1, 5, 20)})} FROM own",
    "split_manifest": with_(*ROLES, IDS, """h AS (SELECT fold_id, role, count(*) AS n, sum(CAST('0x' || substr(sha256(CAST(row_id AS VARCHAR)), 1, 15) AS HUGEINT)) AS a, sum(CAST('0x' || substr(sha256(CAST(row_id AS VARCHAR)), 16, 15) AS HUGEINT)) AS b
  FROM roles JOIN ids USING (ticker, session_date) WHERE status = 'kept' GROUP BY 1, 2)""", f"c AS ({COUNTS})")
    + "SELECT fold_id, " + ", ".join(f"max(CASE WHEN role = '{p}' THEN {x} END) AS n_{p}_{k}" for p in ("train", "val") for k, x in (("raw", "n_raw"), ("purged", "n_raw - n_kept"), ("final", "n_kept")))
    + ", CAST(0 AS BIGINT) AS n_test, " + ", ".join(f"max(CASE WHEN role = '{p}' THEN sha256(n || ':' || a || ':' || b) END) AS {p}_index_hash, max(CASE WHEN role = '{p}' THEN CAST(first_date AS VARCHAR) END) AS {p}_first, max(CASE WHEN role = '{p}' THEN CAST(last_date AS VARCHAR) END) AS {p}_last" for p in ("train", "val"))
    + " FROM c JOIN h USING (fold_id, role) GROUP BY 1",
    "prepared_folds": with_(*ROLES, SCALE, f"v AS (SELECT fold_id, count(*) AS n_val, {', '.join(r(f'avg(({f} - {f}_c) / {f}_s)', f) for f in FEATURES)} FROM roles JOIN fit USING (fold_id) WHERE status = 'kept' AND role = 'val' GROUP BY 1)",
        "t AS (SELECT fold_id, count(*) FILTER (status = 'kept') AS n_train, count(*) AS n_context FROM roles WHERE role = 'train' GROUP BY 1)") + "SELECT * FROM t JOIN v USING (fold_id)",
    "gated_validation": with_(*ROLES, SCALE) + f"SELECT ticker, session_date, fold_id, {', '.join(r(f'({f} - {f}_c) / {f}_s', f) for f in FEATURES)} FROM roles JOIN fit USING (fold_id) WHERE status = 'kept' AND role = 'val'",
    "inner_selection": with_(*ROLES, TRAINED, "z AS (SELECT fold_id, 0 AS inner_fold, n - greatest(5, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT)) AS lo, n AS hi FROM tn)", *INSIDE)
    + "SELECT fold_id, count(*) FILTER (part = 'fit' AND label < lo) AS fit_count, count(*) FILTER (part = 'fit') AS raw_count, count(*) FILTER (part = 'held') AS selection_count, min(CASE WHEN part = 'held' THEN session_date END) AS selection_start FROM inside GROUP BY 1",
    "inner_fold_geometry": with_(*ROLES, TRAINED, """z AS (SELECT fold_id, 1 AS inner_fold, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) - greatest(5, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT)) AS lo, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS hi FROM tn
  UNION ALL SELECT fold_id, 2, n - greatest(5, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT)), n FROM tn)""", *INSIDE)
    + "SELECT fold_id, inner_fold, count(*) FILTER (part = 'fit') AS raw_fit_count, count(*) FILTER (part = 'fit' AND (label IS NULL OR label >= lo)) AS purged_fit_count, count(*) FILTER (part = 'held') AS selection_count, CAST(min(CASE WHEN part = 'held' THEN session_date END) AS VARCHAR) AS selection_start FROM inside GROUP BY 1, 2",
    "experiment_baselines": with_(*ROLES, "fit AS (SELECT fold_id, avg(target_return_5d) AS c FROM roles WHERE status = 'kept' AND role = 'train' GROUP BY 1)",
        "v AS (SELECT fold_id, target_return_5d AS y, c FROM roles JOIN fit USING (fold_id) WHERE status = 'kept' AND role = 'val')",
        "mods AS (SELECT 'baseline_zero' AS model, fold_id, y, 0.0::DOUBLE AS p FROM v UNION ALL SELECT 'baseline_mean', fold_id, y, c FROM v)", regression("mods", "model, fold_id"))
    + f"SELECT model, fold_id, {', '.join(f'round({m}, 6) + 0.0::DOUBLE AS {m}' for m in METRICS)} FROM m",
    "sequence_values": with_(CLEAN, f"""q AS (SELECT ticker, session_date, row_number() {W} AS k,
  string_agg(CAST(CAST(round(log_return_1d * 1000000, 0) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(volume_change_1d * 1000000, 0) AS BIGINT) AS VARCHAR), ';') {last(10)} AS sequence FROM clean)""")
    + "SELECT ticker, session_date, sequence FROM q WHERE k >= 20",
    "audit_by_ticker": with_(AUDIT) + "SELECT * FROM a",
    "audit_totals": with_(AUDIT)
    + "SELECT count(*) AS n_tickers, CAST(sum(n_rows) AS BIGINT) AS total_rows, count(DISTINCT n_rows) AS distinct_lengths, count(DISTINCT first_date) AS distinct_starts, count(DISTINCT last_date) AS distinct_ends, CAST(sum(duplicate_rows) AS BIGINT) AS duplicate_rows, CAST(sum(missing_values) AS BIGINT) AS missing_values FROM a",
    "audit_row_histogram": with_(AUDIT) + "SELECT n_rows, count(*) AS n_tickers FROM a GROUP BY 1",
    "log_returns": keyed(", ".join(r(ret(h), f"log_return_{h}d") for h in (1, 2, 5, 10, 20))),
    "price_shape": keyed(", ".join([r("ln(close / open)", "intraday_return"), r(f"ln(open / lag(close) {W})", "overnight_gap"), r("ln(high / low)", "high_low_range")])),
    "targets": with_(f"t AS (SELECT ticker, session_date, ln(lead(adj_close, 1) {W} / adj_close) AS r1, ln(lead(adj_close, 5) {W} / adj_close) AS r5 FROM bars)")
    + "SELECT ticker, session_date, round(r1, 6) AS target_return_1d, round(r5, 6) AS target_return_5d, CASE WHEN r1 > 0 THEN 1.0::DOUBLE WHEN r1 IS NOT NULL THEN 0.0::DOUBLE END AS target_up_1d, CASE WHEN r5 > 0 THEN 1.0::DOUBLE WHEN r5 IS NOT NULL THEN 0.0::DOUBLE END AS target_up_5d FROM t",
    "volatility": keyed(", ".join(r(gated("stddev_samp", "r", n), f"volatility_{n}d") for n in (5, 20, 60)), VOL, source="ret"),
    "volume_features": keyed(
        ", ".join([r(ret(1, "volume"), "volume_change_1d"), *(x for n in (5, 20) for x in (r(gated("avg", "volume", n), f"volume_sma_{n}d"), r(f"(volume - ({gated('avg', 'volume', n)})) / nullif({gated('stddev_samp', 'volume', n)}, 0)", f"volume_zscore_{n}d")))])
    ),
    "sma_ratios": keyed(cols(SMA_OUT)),
    "bollinger": keyed(cols(BB_OUT), *BB, source="bb"),
    "trend_slope": keyed(cols(SLOPE_OUT), NUM, source="num"),
    "stochastic": keyed(cols(STOCH_OUT), *STOCH, source="k3"),
    "ema": keyed(cols({f"ema_{n}": f"ema_{n}" for n in (10, 20, 50)}), *EMA, source="e50"),
    "macd": keyed(cols(MACD_OUT), *MACD, source="f4"),
    "rsi": keyed(r(RSI_OUT, "rsi_14"), *RSI, source="g3"),
    "dmi_adx": keyed(cols(DMI_OUT), *DMI, source="h7"),
    "technical_all": with_(
        *EMA, *MACD[1:], *RSI[1:], *DMI[1:], *BB, *STOCH,
        f"q1 AS (SELECT ticker, session_date, {cols({f'ema_{n}': f'ema_{n}' for n in (10, 20, 50)})} FROM e50)", f"q2 AS (SELECT ticker, session_date, {cols(MACD_OUT)} FROM f4)", f"q3 AS (SELECT ticker, session_date, {r(RSI_OUT, 'rsi_14')} FROM g3)",
        f"q4 AS (SELECT ticker, session_date, {cols(DMI_OUT)} FROM h7)", f"q5 AS (SELECT ticker, session_date, {cols(BB_OUT)} FROM bb)", f"q6 AS (SELECT ticker, session_date, {cols(STOCH_OUT)} FROM k3)",
        f"q7 AS (SELECT ticker, session_date, {cols(SMA_OUT)} FROM bars)", f"q8 AS (SELECT ticker, session_date, {cols(SLOPE_OUT)} FROM num)",
    )
    + "SELECT * FROM q1 " + " ".join(f"JOIN q{i} USING (ticker, session_date)" for i in range(2, 9)),
    "market_context": with_(*INDEX, OWN, BREADTH) + f"SELECT ticker, own.session_date, {cols(MARKET_OUT)} FROM own LEFT JOIN i4 i USING (session_date) LEFT JOIN br USING (session_date)",
    "market_regime": "WITH " + ", ".join(INDEX) + " SELECT session_date, CAST(trend AS DOUBLE) AS market_regime_trend, CAST(vol AS DOUBLE) AS market_regime_volatility FROM i4",
    "sector_context": with_(OWN, *SECTOR) + f"SELECT ticker, own.session_date, {cols(SECTOR_OUT)} FROM own LEFT JOIN s1 USING (sector, session_date)",
    "cross_asset": with_(*CROSS) + f"SELECT ticker, bars.session_date, {cols(CROSS_OUT)}, CAST(NULL AS DOUBLE) AS crude_return_1d FROM bars LEFT JOIN y1 USING (session_date) LEFT JOIN y2 USING (session_date)",
    "context_all": with_(*INDEX, OWN, BREADTH, *SECTOR, *CROSS)
    + f"SELECT ticker, own.session_date, {cols(MARKET_OUT)}, {cols(SECTOR_OUT)}, CAST(coalesce(i.trend, 0) AS DOUBLE) AS market_regime_trend, CAST(coalesce(i.vol, 0) AS DOUBLE) AS market_regime_volatility, {cols(CROSS_OUT)}, {r('oil', 'crude_return_1d')} "
    "FROM own LEFT JOIN i4 i USING (session_date) LEFT JOIN br USING (session_date) LEFT JOIN s1 USING (sector, session_date) LEFT JOIN y1 USING (session_date) LEFT JOIN y2 USING (session_date) LEFT JOIN y3 USING (session_date)",
    "information_cutoff_violations": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate",
    "model_dataset": with_(CLEAN.replace(" AND target_return_5d IS NOT NULL", ""))
    + f"SELECT ticker, session_date, {', '.join(r(f, f) for f in FEATURES)}, round(target_return_1d, 6) AS target_return_1d, CAST(target_up_1d AS DOUBLE) AS target_up_1d, row_number() OVER (ORDER BY session_date, ticker) - 1 AS row_id FROM clean",
    "label_outcome_dates": keyed(f"lead(session_date, 5) {W} AS outcome_date"),
    "chronological_roles": with_(*roles(CHRONO, 5)) + "SELECT ticker, session_date, role, status FROM roles",
    "walk_forward_folds": with_(*roles(walk(600, 200, 250, 10), 5)) + COUNTS,
    "walk_forward_rolling": with_(*roles(walk(400, 300, 300, expanding=False), 1)) + COUNTS,
    "purge_counts": with_(*ROLES) + "SELECT fold_id, role, ticker, count(*) AS n_purged FROM roles WHERE status = 'purged' GROUP BY ALL",
    "inner_folds": with_(*roles(INNER, 5)).replace("folds AS (", "z AS (SELECT n, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS e, greatest(5, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT)) AS s FROM n), folds AS (") + COUNTS,
    "scaler_standard": with_(*ROLES) + "SELECT fold_id, " + ", ".join(f"round(avg({f}), 6) AS {f}__centre, round(CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END, 6) AS {f}__scale" for f in FEATURES) + " FROM roles WHERE status = 'kept' AND role = 'train' GROUP BY 1",
    "scaler_robust": with_(*ROLES) + "SELECT fold_id, " + ", ".join(f"round(quantile_cont({f}, 0.5), 6) AS {f}__centre, round(quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25), 6) AS {f}__scale" for f in FEATURES) + " FROM roles WHERE status = 'kept' AND role = 'train' GROUP BY 1",
    "scaled_validation": with_(*ROLES, "fit AS (SELECT fold_id, " + ", ".join(f"avg({f}) AS {f}_c, stddev_pop({f}) AS {f}_s" for f in FEATURES) + " FROM roles WHERE status = 'kept' AND role = 'train' GROUP BY 1)")
    + f"SELECT ticker, session_date, fold_id, {', '.join(r(f'({f} - {f}_c) / {f}_s', f) for f in FEATURES)} FROM roles JOIN fit USING (fold_id) WHERE status = 'kept' AND role = 'val'",
    "lookback_sequences": with_(CLEAN, f"""q AS (SELECT ticker, session_date, row_number() {W} AS k,
  string_agg(CAST(CAST(round(log_return_1d * 1000, 0) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(volume_change_1d * 1000, 0) AS BIGINT) AS VARCHAR), ';') {last(5)} AS sequence FROM clean)""")
    + "SELECT ticker, session_date, sequence FROM q WHERE k >= 10",
    "baseline_predictions": with_(*ROLES, "fit AS (SELECT fold_id, avg(target_return_5d) AS m, avg(CASE WHEN target_up_5d > 0 THEN 1.0 ELSE 0.0 END) AS u FROM roles WHERE status = 'kept' AND role = 'train' GROUP BY 1)")
    + "SELECT ticker, session_date, fold_id, round(m, 6) AS y_pred, round(u, 6) AS p1 FROM roles JOIN fit USING (fold_id) WHERE status = 'kept' AND role = 'val'",
    "regression_metrics": with_(*ROLES, PRED, regression("pred", "fold_id, ticker")) + f"SELECT fold_id, ticker, n, {', '.join(r(m, m) for m in METRICS)} FROM m",
    "classification_metrics": with_(*ROLES, PRED, """k AS (SELECT fold_id, ticker, count(*) AS n, avg(-(up * ln(greatest(least(p1, 1 - 1e-15), 1e-15)) + (1 - up) * ln(1 - greatest(least(p1, 1 - 1e-15), 1e-15)))) AS logloss,
  count(*) FILTER (p1 >= 0.5 AND up = 1) AS tp, count(*) FILTER (p1 >= 0.5 AND up = 0) AS fp, count(*) FILTER (p1 < 0.5 AND up = 1) AS fn, count(*) FILTER ((p1 >= 0.5) = (up = 1)) AS ok FROM pred GROUP BY 1, 2)""")
    + "SELECT fold_id, ticker, n, round(logloss, 6) AS logloss, round(ok / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM k",
    "macro_objective": with_(*ROLES, PRED, regression("pred", "fold_id, ticker")) + "SELECT round(avg(s), 6) AS objective, count(*) AS n_folds FROM (SELECT fold_id, avg(relative_rmse) AS s FROM m GROUP BY 1)",
    "experiment_leaderboard": with_(*ROLES, PRED, "mods AS (SELECT 'reversal' AS model, fold_id, y, p FROM pred UNION ALL SELECT 'momentum', fold_id, y, -p FROM pred UNION ALL SELECT 'zero', fold_id, y, 0.0::DOUBLE FROM pred)", regression("mods", "model, fold_id"))
    + f"SELECT model, {', '.join(r(f'avg({m})', m) for m in METRICS)} FROM m GROUP BY 1",
    "event_bars": """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS d, value, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS z FROM events)
SELECT event_type AS ticker, d AS session_date, max(CASE WHEN a = 1 THEN value END) AS open, max(value) AS high, min(value) AS low, max(CASE WHEN z = 1 THEN value END) AS close, CAST(count(*) AS DOUBLE) AS volume FROM e GROUP BY 1, 2""",
}

#: Days are compared as text.
DAYS = {
    **dict.fromkeys(("panel_summary", "quality_report", "audit_totals", "audit_row_histogram", "information_cutoff_violations", "purge_counts", "scaler_standard", "scaler_robust"), ()),
    **dict.fromkeys(("regression_metrics", "classification_metrics", "macro_objective", "experiment_leaderboard"), ()),
    **dict.fromkeys(("audit_by_ticker", "walk_forward_folds", "walk_forward_rolling", "inner_folds"), ("first_date", "last_date")),
    "label_outcome_dates": ("session_date", "outcome_date"),
    **dict.fromkeys(("order_report", "repeated_keys", "split_manifest", "prepared_folds", "inner_fold_geometry", "experiment_baselines"), ()),
    "inner_selection": ("selection_start",),
}


def _plain(name: str, sql: str) -> str:
    days = DAYS.get(name, ("session_date",))
    if not days:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({sql})"


SQL: dict[str, str] = {name: _plain(name, sql) for name, sql in _SQL.items()}

#: Another way to the same rows.
SQL |= {"technical_sliced": SQL["technical_all"], "market_regime_blocks": SQL["market_regime"], "scaler_robust_selected": SQL["scaler_robust"]}
SQL["prices_sliced"] = f"SELECT * FROM ({SQL['volatility']}) JOIN ({SQL['targets']}) USING (ticker, session_date)"
SQL |= {name: f"SELECT upper(ticker) AS ticker, session_date, {', '.join(f'round({c}, 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'adj_close', 'volume'))} FROM ({SQL['bars']})" for name in ("csv_round_trip", "wide_frames")}
SQL["validated_save"] = SQL["csv_round_trip"].replace("upper(ticker)", "ticker")
