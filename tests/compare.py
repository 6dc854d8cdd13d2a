"""Run a query in Spark and its SQL in DuckDB and compare all rows."""

import math
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(frame, con, sql):
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.sql(sql)
    want = table(result.columns, result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w]
    assert not wrong, wrong[:3]
