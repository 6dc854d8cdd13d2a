"""Small deterministic panels."""

import math
from datetime import date, timedelta


def weekdays(n, start=date(2020, 1, 1)):
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(days=1)
    return out


def prices(ticker, n=260, scale=1.0, start=date(2020, 1, 1)):
    rows = []
    for i, day in enumerate(weekdays(n, start)):
        close = (100 + 0.15 * i + 2 * math.sin(i / 7)) * scale
        rows.append((ticker, day, close * 0.998, close * 1.01, close * 0.99, close, close, 1000.0 + 10 * (i % 17)))
    return rows


SCHEMA = "ticker string, session_date date, open double, high double, low double, close double, adj_close double, volume double"


def frame(spark, *tickers, n=260):
    return spark.createDataFrame([r for i, t in enumerate(tickers) for r in prices(t, n, 1 + 0.3 * i)], SCHEMA)


def collected(df, *columns):
    return {(r["ticker"], r["session_date"]): tuple(r[c] for c in columns) for r in df.collect()}


def close_to(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is b
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
