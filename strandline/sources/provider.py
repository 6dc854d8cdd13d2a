"""A price provider as a Spark data source, and validated ingestion of a universe.

Any function from (ticker, period) to rows serves as the provider.  Each ticker is
a partition of its own, so calls run side by side on the executors, and a call
that fails is a row with its error instead of the end of the job.  A provider that can
be asked for a range of days takes filters on tickers and days, and is asked only for
what a saved universe does not have yet.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from strandline.operators.quality import violations_by_ticker
from strandline.session import delete, exists
from strandline.sources.panel import COLUMNS, NUMERIC, PROVIDER_NAMES, day, normalise

#: Rows of one ticker by the provider's column names or the canonical ones.
Fetch = Callable[[str, str], Iterable[Mapping[str, Any]]]
#: The same for a ticker and its first and last day (ISO text, inclusive, None: open), with days as ISO text.
RangeFetch = Callable[[str, str | None, str | None], Iterable[Mapping[str, Any]]]

_SCHEMA = "ticker string, session_date string, " + ", ".join(f"{c} string" for c in NUMERIC) + ", ingest_id long, error string"


def _answer(ticker: str, rows: Iterable[Mapping[str, Any]]) -> list[tuple]:
    out: list[tuple] = []
    text = lambda v: None if v is None else str(v)
    for i, row in enumerate(rows):
        known = {PROVIDER_NAMES.get(k, k): v for k, v in row.items()}
        if missing := [c for c in COLUMNS if c != "ticker" and c not in known]:
            raise ValueError(f"missing columns: {missing}")
        out.append((ticker, text(known["session_date"]), *(text(known[c]) for c in NUMERIC), i, None))
    return out


def _failure(ticker: str, error: Exception) -> tuple:
    return (ticker, None, *(None for _ in NUMERIC), None, f"{type(error).__name__}: {error}")


def _iso(value: Any) -> str | None:
    """The day that a text begins with, None if it begins with none."""
    try:
        return dt.date.fromisoformat(str(value)[:10]).isoformat()
    except ValueError:
        return None


class _Whole(DataSourceReader):
    """Whole histories of a period."""

    def __init__(self, fetch: Fetch, tickers: Sequence[str], period: str):
        self.fetch, self.tickers, self.period = fetch, list(tickers), period

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(t) for t in self.tickers]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ticker = partition.value
        try:
            rows = _answer(ticker, self.fetch(ticker, self.period))
            if not rows:
                raise ValueError("no rows")
        except Exception as error:  # one ticker's failure is its own
            rows = [_failure(ticker, error)]
        yield from rows


class _Range(DataSourceReader):
    """Ranges of days; filters on tickers and days narrow what the provider is asked for, and Spark applies them again."""

    def __init__(self, fetch: RangeFetch, tickers: Sequence[str], starts: Mapping[str, str]):
        self.fetch, self.tickers, self.starts = fetch, list(tickers), dict(starts)
        self.first: str | None = None
        self.last: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            of = f.attribute if hasattr(f, "attribute") else None
            if of == ("ticker",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = [t for t in self.tickers if t in wanted]
            elif of == ("session_date",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and (at := _iso(f.value)):
                # Text of a later time on the same day is larger, so that the day itself is always asked for.
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(at, self.first or at)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.last = min(at, self.last or at)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(t) for t in self.tickers] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ticker = partition.value
        if ticker is None:
            return
        own = self.starts.get(ticker)
        first = max(filter(None, (own, self.first)), default=None)
        try:
            rows = _answer(ticker, self.fetch(ticker, first, self.last))
            if not rows and first is None and self.last is None:
                raise ValueError("no rows")
        except Exception as error:
            if self.first or self.last:
                raise  # a failure's row has no day, so a filter on days would hide it
            rows = [_failure(ticker, error)]
        yield from rows


def _load(spark: SparkSession, reader_of: Callable[[], DataSourceReader]) -> DataFrame:
    class Provider(DataSource):
        @classmethod
        def name(cls) -> str:
            return "ohlcv_provider"

        def schema(self) -> str:
            return _SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return reader_of()

    spark.dataSource.register(Provider)
    return spark.read.format("ohlcv_provider").load()


def _named(tickers: Iterable[str]) -> list[str]:
    names = list(dict.fromkeys(t.strip().upper() for t in tickers))
    if not names or not all(names):
        raise ValueError("tickers are needed, and none may be blank")
    return names


def scan(spark: SparkSession, fetch: Fetch, tickers: Iterable[str], *, period: str = "10y") -> DataFrame:
    """Rows as text with their order within the ticker, and ``error`` where a ticker could not be read."""
    names = _named(tickers)
    return _load(spark, lambda: _Whole(fetch, names, period))


def scan_range(spark: SparkSession, fetch: RangeFetch, tickers: Iterable[str], *, starts: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of ``scan`` from a provider of ranges: filters on ``ticker`` and ``session_date`` reach its calls.

    ``starts`` gives tickers a first day of their own.  An answer without rows is a failure
    only where neither a start nor a filter bounds the days.  Where a filter bounds them, a call
    that fails ends the job, as the row with its error has no day.  Switches on Spark's
    pushing of filters into Python sources for the session.
    """
    names, own = _named(tickers), {k.strip().upper(): v for k, v in (starts or {}).items()}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return _load(spark, lambda: _Range(fetch, names, own))


def _judge(rows: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The rows that were read, the tickers without a violation, and what went wrong with the others."""
    failed = {r["ticker"]: r["error"] for r in rows.where("error is not null").select("ticker", "error").collect()}
    read = rows.where("error is null").drop("error")
    told = violations_by_ticker(read).collect()
    for r in told:
        found = {k: v for k, v in r.asDict().items() if k not in ("ticker", "n_rows") and v}
        if found:
            failed[r["ticker"]] = "; ".join(f"{k}: {v}" for k, v in found.items())
    return read, sorted(r["ticker"] for r in told if r["ticker"] not in failed), failed


def _save(spark: SparkSession, read: DataFrame, fine: list[str], failed: dict[str, str], path: str, run: str, mode: str) -> None:
    """The fine tickers' rows below ``path``, one file a ticker, and the run's outcome in ``_runs``."""
    if fine:
        good = normalise(read).where(F.col("ticker").isin(fine)).select(*COLUMNS, F.col("ticker").alias("of"))
        out = good.repartition("of").sortWithinPartitions("of", "session_date").write.partitionBy("of").option("header", True)
        # Only the folders of tickers among the rows are replaced, once all of them are written.
        (out.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else out).mode(mode).csv(path)
    outcome = [(run, t, None) for t in fine] + [(run, t, e) for t, e in sorted(failed.items())]
    spark.createDataFrame(outcome, "run string, ticker string, error string").coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/_runs")


def fetch_universe(spark: SparkSession, fetch: Fetch, tickers: Iterable[str], path: str, *, period: str = "10y") -> tuple[list[str], dict[str, str]]:
    """Read, validate and save all tickers: CSV files below ``path``, one folder a ticker.

    Returns the tickers saved and what went wrong with the others (the call itself, or
    the kinds and numbers of violations); both are a row a ticker that the caller named.

    A run may be repeated: it replaces the files of the tickers it saves and touches no others, so
    a ticker that fails keeps what an earlier run saved.  The provider is called once a
    ticker; its answer is kept under the run's own id until the run has ended, and
    ``_runs`` below ``path`` then has the run's id, its tickers and their outcome.
    """
    run = uuid.uuid4().hex
    raw = f"{path.rstrip('/')}/_raw/{run}"
    scan(spark, fetch, tickers, period=period).write.parquet(raw)
    rows = spark.read.parquet(raw)
    read, fine, failed = _judge(rows)
    _save(spark, read, fine, failed, path, run, "overwrite")
    delete(spark, raw)
    return fine, failed


def last_sessions(spark: SparkSession, path: str) -> dict[str, str]:
    """The last saved day of each ticker of a saved universe (a row a ticker); none where nothing is saved."""
    if not exists(spark, path):
        return {}
    saved = spark.read.schema(f"{', '.join(f'{c} string' for c in COLUMNS)}, of string").option("header", True).csv(path)
    return {r["of"]: r["last"] for r in saved.groupBy("of").agg(F.max(day("session_date")).cast("string").alias("last")).collect() if r["last"]}


def update_universe(spark: SparkSession, fetch: RangeFetch, tickers: Iterable[str], path: str) -> tuple[list[str], dict[str, str]]:
    """Ask for what came after each ticker's last saved day, check it and add it to the saved universe.

    Returns the tickers that gained rows and what went wrong with others.  A ticker that is not
    saved yet is asked for its whole history.  No new rows are no failure; rows up to the
    last saved day are one (``not_after``), so that no day is ever saved twice, and so are all
    violations that ``fetch_universe`` knows.  A ticker's new rows are one file, so that a
    run that ended half-way through its save left whole tickers: the next run asks for the others' days
    alone.  The files of a ticker add up by run; ``fetch_universe`` makes them one again.  Two
    runs into one path at once are not guarded against.
    """
    names, last = _named(tickers), last_sessions(spark, path)
    following = {t: (dt.date.fromisoformat(d) + dt.timedelta(1)).isoformat() for t, d in last.items()}
    run = uuid.uuid4().hex
    raw = f"{path.rstrip('/')}/_raw/{run}"
    scan_range(spark, fetch, names, starts={t: following[t] for t in names if t in following}).write.parquet(raw)
    rows = spark.read.parquet(raw)
    read, fine, failed = _judge(rows)
    known = [t for t in fine if t in last]
    if known:
        saved = spark.createDataFrame([(t, last[t]) for t in known], "ticker string, last string")
        early = read.join(saved, "ticker").where(day("session_date") <= F.col("last").cast("date")).groupBy("ticker").agg(F.count("*").alias("n"))
        failed |= {r["ticker"]: f"not_after: {r['n']}" for r in early.collect()}
        fine = [t for t in fine if t not in failed]
    _save(spark, read, fine, failed, path, run, "append")
    delete(spark, raw)
    return fine, failed
