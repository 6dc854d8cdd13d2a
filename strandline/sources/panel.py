"""The daily panel: schema, reading, normalising, writing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The canonical columns and the provider's names for them.
COLUMNS = ("session_date", "ticker", "open", "high", "low", "close", "adj_close", "volume")
NUMERIC = COLUMNS[2:]
PROVIDER_NAMES = {"Date": "session_date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}

#: As read from text: everything is text, so that bad values can be counted.
RAW = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def number(column: str):
    """A double, null where the value is no number or not finite-valued text; NaN becomes null."""
    value = F.expr(f"try_cast(`{column}` as double)")
    return F.when(~F.isnan(value), value)


def day(column: str):
    """The calendar day of a date, timestamp or text; null where there is none."""
    return F.expr(f"try_cast(try_cast(`{column}` as timestamp_ntz) as date)")


def pick_ticker(frame: DataFrame, ticker: str, *, separator: str = "|") -> DataFrame:
    """One ticker's slice of a wide provider frame, whose columns are ``field|ticker``."""
    tail = f"{separator}{ticker}"
    found = {c: c[: -len(tail)] for c in frame.columns if c.endswith(tail)}
    if not found:
        if any(separator in c for c in frame.columns):
            raise ValueError(f"ticker {ticker!r} is not in the provider's columns")
        return frame
    plain = [c for c in frame.columns if separator not in c]
    return frame.select(*(F.col(f"`{c}`") for c in plain), *(F.col(f"`{c}`").alias(field) for c, field in found.items()))


def wide_to_long(frame: DataFrame, *, key: str = "session_date", separator: str = "|") -> DataFrame:
    """All tickers of a wide provider frame, one row a day and ticker."""
    tickers = list(dict.fromkeys(c.split(separator, 1)[1] for c in frame.columns if separator in c))
    fields = list(dict.fromkeys(c.split(separator, 1)[0] for c in frame.columns if separator in c))
    if not tickers:
        raise ValueError("no column names a ticker")
    known = set(frame.columns)
    entry = lambda t: F.struct(F.lit(t).alias("ticker"), *((F.col(f"`{f}{separator}{t}`") if f"{f}{separator}{t}" in known else F.lit(None)).cast("double").alias(f) for f in fields))
    return frame.select(F.col(key), F.explode(F.array(*map(entry, tickers))).alias("r")).select(key, "r.*")


def normalise(frame: DataFrame, ticker: str | None = None, *, names: Mapping[str, str] = PROVIDER_NAMES) -> DataFrame:
    """The canonical columns in order: days without zone or time, numbers or null.

    ``ticker`` is trimmed and upper-cased; without it the frame needs a ticker column.
    """
    frame = frame.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in frame.columns))
    if ticker is not None:
        if not ticker.strip():
            raise ValueError("ticker is blank")
        frame = frame.withColumn("ticker", F.lit(ticker.strip().upper()))
    if missing := [c for c in COLUMNS if c not in frame.columns]:
        raise ValueError(f"missing columns: {missing}")
    return frame.select(day("session_date").alias("session_date"), F.upper(F.trim(F.col("ticker").cast("string"))).alias("ticker"), *(number(c).alias(c) for c in NUMERIC))


def read_csv(spark: SparkSession, path: str | Sequence[str], *, ticker_from_file: bool = False) -> DataFrame:
    """Raw text columns of CSV files with their file's name and the order of lines within it."""
    frame = spark.read.schema(RAW).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
    frame = frame.withColumns({"source_file": F.col("_metadata.file_name"), "ingest_id": F.monotonically_increasing_id()})
    if ticker_from_file:
        frame = frame.withColumn("ticker", F.regexp_replace("source_file", r"\.csv(\.gz)?$", ""))
    return frame


def save_csv(frame: DataFrame, path: str) -> None:
    """CSV files with a header; what was there is replaced.  ``frame`` must not read from ``path``."""
    frame.select(*COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def save_parquet(frame: DataFrame, path: str) -> None:
    """Parquet in one folder a month (column ``month``), sorted by ticker and day, so that filters on either prune; replaces
    what was there.  Large months are several files."""
    rows = frame.select(*COLUMNS, F.date_format("session_date", "yyyy-MM").alias("month"))
    by = ("month", "ticker", "session_date")
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("month").parquet(path)


def bars_from_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel from line items: brands are tickers, ship dates sessions, unit prices trades.

    First and last trades follow from a total order of the rows.  Prices are
    left unrounded.  Open and close come from one aggregate each, so the join's
    rows are combined before the exchange on (ticker, day).
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("ticker"))
    trades = items.join(parts, items.l_partkey == parts.p_partkey).select(
        "ticker",
        F.col("l_shipdate").cast("date").alias("session_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("o"),
    )
    return trades.groupBy("ticker", "session_date").agg(
        F.min_by("px", "o").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "o").alias("close"),
        F.max_by("px", "o").alias("adj_close"),
        F.sum("l_quantity").alias("volume"),
    ).select(*COLUMNS)


def daily_series(spark: SparkSession, sf_dir: str, priority: str | None = None) -> DataFrame:
    """A one-row-a-day series: the mean order price, of all orders or of one priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    if priority is not None:
        orders = orders.where(F.col("o_orderpriority") == priority)
    # Cents are whole numbers, so the sum is the same in any order.
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("session_date")).agg((cents.cast("double") / F.count("*") / 100.0).alias("close"))


def daily_series_of(spark: SparkSession, sf_dir: str, kinds: Mapping[str, str | None]) -> DataFrame:
    """Several ``daily_series`` side by side, from one pass over the orders: a column for each priority named."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    wanted = lambda p: F.lit(True) if p is None else F.col("o_orderpriority") == p
    means = [(F.sum(F.when(wanted(p), cents)).cast("double") / F.count_if(wanted(p)) / 100.0).alias(name) for name, p in kinds.items()]
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderdate").cast("date").alias("session_date")).agg(*means)


def with_sector(panel: DataFrame) -> DataFrame:
    """The brand's number modulo five as the sector."""
    return panel.withColumn("sector", F.concat(F.lit("S"), (F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 5).cast("string")))
