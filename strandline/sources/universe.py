"""The development universe and per-ticker ingestion that isolates failures."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.panel import normalise

# The development universe, in order.
DEV_UNIVERSE = (
    *("AAPL", "MSFT", "GOOGL", "AMZN", "META", "NVDA", "AVGO", "AMD", "CRM", "ORCL", "ADBE", "CSCO", "IBM", "QCOM", "AMAT", "MU", "TXN"),
    *("JPM", "BAC", "WFC", "GS", "MS", "V", "MA", "BRK-B"),
    *("JNJ", "UNH", "LLY", "MRK", "ABBV", "PFE", "TMO"),
    *("XOM", "CVX", "COP"),
    *("CAT", "DE", "GE", "HON", "BA"),
    *("WMT", "COST", "HD", "MCD", "KO", "PEP", "PG"),
    *("DIS", "NFLX"),
    "NEE",
)


def dev_universe(spark: SparkSession, limit: int | None = None) -> DataFrame:
    """(position, ticker); ``limit`` takes a prefix."""
    return spark.createDataFrame(list(enumerate(DEV_UNIVERSE[:limit])), "position int, ticker string")


def only_universe(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """The panel's rows of a universe.  A universe is a list of names, but its size is left to the optimiser."""
    return panel.join(universe.select("ticker"), "ticker", "left_semi")


def ingest(fetch: Callable[[str], DataFrame], tickers: Iterable[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """All tickers that could be read, normalised, and what went wrong with the others.

    ``fetch`` is the provider scan: any callable from ticker to frame (there is
    no network where this is built; a data source that calls one fits in here).
    """
    frames, failed = [], {}
    for raw in tickers:
        ticker = raw.strip().upper()
        try:
            frames.append(normalise(fetch(ticker), ticker))
        except Exception as error:  # one provider failure must not end the others
            failed[ticker] = str(error)
    return (reduce(DataFrame.unionByName, frames) if frames else None), failed


def ingest_csv(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """A provider that reads ``folder/TICKER.csv``."""

    def fetch(ticker: str) -> DataFrame:
        return spark.read.option("header", True).csv(f"{folder}/{ticker}.csv")

    return fetch


def failures(spark: SparkSession, failed: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(failed.items()), "ticker string, message string").orderBy(F.col("ticker"))
