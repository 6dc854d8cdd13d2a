"""Panel validation in one aggregate pass, builder guards, audit reports, information cutoffs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandline.functions.windows import required
from strandline.session import delete, rename
from strandline.sources.panel import COLUMNS, NUMERIC, day, number

PRICES = ("open", "high", "low", "close", "adj_close")


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _value(c: str) -> Column:
    """The number, null for NaN, which would compare as larger than all others."""
    return number(c)


def _missing(c: str) -> Column:
    return _value(c).isNull()


def _row_rules() -> dict[str, Column]:
    """Violation counts that each row is judged for alone."""
    low, high, opened, closed = (_value(c) for c in ("low", "high", "open", "close"))
    relation = (low > high) | (opened < low) | (opened > high) | (closed < low) | (closed > high)
    return {
        "n_rows": F.count("*"),
        "bad_date": _count(day("session_date").isNull()),
        "null_ticker": _count(F.col("ticker").isNull()),
        "blank_ticker": _count(F.trim("ticker") == ""),
        **{f"missing_{c}": _count(_missing(c)) for c in NUMERIC},
        **{f"infinite_{c}": _count(F.abs(_value(c)) == F.lit(float("inf"))) for c in NUMERIC},
        **{f"non_positive_{c}": _count(_value(c) <= 0) for c in PRICES},
        "negative_volume": _count(_value("volume") < 0),
        "ohlc_relation": _count(relation),
    }


def quality_report(panel: DataFrame) -> DataFrame:
    """One row of violation counts over the whole panel, of text or typed columns.

    Row-wise rules are one aggregate pass.  Repeated keys need an exchange on
    the key, order of days needs ``ingest_id`` (rows have no order of their own;
    without it the count is null).
    """
    required(panel, COLUMNS)
    rows = panel.agg(*(c.alias(n) for n, c in _row_rules().items()))
    keys = panel.groupBy("ticker", "session_date").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_keys"))
    out = rows.crossJoin(F.broadcast(keys))
    if "ingest_id" in panel.columns:
        # Lines have an order within their file only.
        where = ["ticker", "source_file"] if "source_file" in panel.columns else ["ticker"]
        before = F.lag(day("session_date")).over(Window.partitionBy(*where).orderBy("ingest_id"))
        late = panel.select("ticker", (before > day("session_date")).alias("late")).groupBy("ticker").agg(F.max(F.coalesce("late", F.lit(False))).alias("late"))
        return out.crossJoin(F.broadcast(late.agg(F.count_if("late").alias("unordered_tickers"))))
    return out.withColumn("unordered_tickers", F.lit(None).cast("long"))


def violations_by_ticker(panel: DataFrame) -> DataFrame:
    """The counts of ``quality_report`` for each ticker, from one exchange; ``ingest_id`` orders its rows."""
    required(panel, (*COLUMNS, "ingest_id"))
    w = Window.partitionBy("ticker").orderBy("ingest_id")
    same = F.count("*").over(Window.partitionBy("ticker", "session_date"))
    rows = panel.withColumns({"_late": F.lag(day("session_date")).over(w) > day("session_date"), "_same": same})
    return rows.groupBy("ticker").agg(*(c.alias(n) for n, c in _row_rules().items()), _count(F.col("_same") > 1).alias("duplicate_keys"), _count(F.col("_late")).alias("unordered_rows"))


def _raise_for(found: dict[str, int]) -> None:
    errors = [f"{name}: {n}" for name, n in found.items() if name != "n_rows" and n]
    if errors:
        raise ValueError("panel validation failed:\n- " + "\n- ".join(errors))


def validate(panel: DataFrame) -> None:
    """Raise one error that lists every kind of violation with its count."""
    _raise_for(quality_report(panel).first().asDict())


def save_validated(panel: DataFrame, path: str) -> dict[str, int]:
    """Check and save a panel (Parquet, by ticker and day) in one job; the counts of ``violations_by_ticker`` over all rows.

    The rows move once, by ticker; what repeats or stands out of order is told by windows in that
    exchange, and everything is counted while the rows are written.  They go to a folder beside
    ``path``, which takes its place if nothing was found and is removed, with one error, if anything was.
    """
    required(panel, COLUMNS)
    spark, seen = panel.sparkSession, Observation(f"panel-{uuid.uuid4().hex}")
    by_day = Window.partitionBy("ticker").orderBy("session_date")
    again = (F.lag("session_date").over(by_day) == F.col("session_date")) | (F.lead("session_date").over(by_day) == F.col("session_date"))
    rows = panel.withColumns({"_again": F.coalesce(again, F.lit(False)), "_late": F.lit(False)})
    if "ingest_id" in panel.columns:
        late = F.lag(day("session_date")).over(Window.partitionBy("ticker").orderBy("ingest_id")) > day("session_date")
        rows = rows.withColumn("_late", F.coalesce(late, F.lit(False)))
    counts = [c.alias(n) for n, c in _row_rules().items()] + [F.count_if("_again").alias("duplicate_keys"), F.count_if("_late").alias("unordered_rows")]
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.observe(seen, *counts).select(*COLUMNS).write.parquet(beside)
    found = {k: int(v) for k, v in seen.get.items()}
    try:
        _raise_for(found)
    except ValueError:
        delete(spark, beside)
        raise
    delete(spark, path)
    rename(spark, beside, path)
    return found


def guarded(panel: DataFrame, *, positive: tuple[str, ...] = (), ohlc: bool = False) -> DataFrame:
    """``panel`` with the checks of ``guard`` inside its plan: no job of their own, and the first row that breaks one
    ends whatever reads it.  Repeats are told in the order by ticker and day that features need anyway."""
    required(panel, ("ticker", "session_date", *positive))
    checks = {"null key": F.col("ticker").isNotNull() & F.col("session_date").isNotNull()}
    for c in positive:
        checks[f"{c} is missing, not finite or not positive"] = _value(c).isNotNull() & (F.abs(_value(c)) != float("inf")) & (_value(c) > 0)
    if ohlc:
        top, bottom = F.greatest("open", "close"), F.least("open", "close")
        checks["price relations"] = ~((F.col("high") < top) | (F.col("low") > bottom) | (F.col("low") > F.col("high")))
    out = panel
    for what, fine in checks.items():
        out = out.where(F.assert_true(F.coalesce(fine, F.lit(what == "price relations")), F.lit(f"invalid panel: {what}")).isNull())
    before = F.lag("session_date").over(Window.partitionBy("ticker").orderBy("session_date"))
    once = F.coalesce(before != F.col("session_date"), F.lit(True))
    return out.withColumn("_once", once).where(F.assert_true("_once", F.lit("repeated (ticker, session_date)")).isNull()).drop("_once")


def guard(panel: DataFrame, *, positive: tuple[str, ...] = (), ohlc: bool = False) -> None:
    """The builders' fail-fast checks: unique keys, finite and positive values, price relations."""
    required(panel, ("ticker", "session_date", *positive))
    checks = [_count(F.col("ticker").isNull() | F.col("session_date").isNull()).alias("null key")]
    for c in positive:
        checks += [_count(_missing(c)).alias(f"{c} missing"), _count(F.abs(_value(c)) == float("inf")).alias(f"{c} not finite"), _count(_value(c) <= 0).alias(f"{c} not positive")]
    if ohlc:
        top, bottom = F.greatest("open", "close"), F.least("open", "close")
        checks.append(_count((F.col("high") < top) | (F.col("low") > bottom) | (F.col("low") > F.col("high"))).alias("price relations"))
    found = {k: v for k, v in panel.agg(*checks).first().asDict().items() if v}
    if found:
        raise ValueError(f"invalid panel: {found}")
    if panel.groupBy("ticker", "session_date").count().where("count > 1").take(1):
        raise ValueError("repeated (ticker, session_date)")


def audit(panel: DataFrame) -> DataFrame:
    """One row a ticker: rows, first and last day, days, repeats, missing values, extremes."""
    missing = sum((F.col(c).isNull().cast("long") for c in COLUMNS), F.lit(0).cast("long"))
    return panel.groupBy("ticker").agg(
        F.count("*").alias("n_rows"),
        F.min("session_date").alias("first_date"),
        F.max("session_date").alias("last_date"),
        F.countDistinct("session_date").alias("n_dates"),
        (F.count("*") - F.countDistinct("session_date")).alias("duplicate_rows"),
        F.sum(missing).alias("missing_values"),
        F.min("close").alias("min_close"),
        F.max("close").alias("max_close"),
        F.min("volume").alias("min_volume"),
        F.max("volume").alias("max_volume"),
    )


def audit_totals(audited: DataFrame) -> DataFrame:
    """One row over all tickers: whether their lengths and bounds agree."""
    return audited.agg(
        F.count("*").alias("n_tickers"),
        F.sum("n_rows").alias("total_rows"),
        F.countDistinct("n_rows").alias("distinct_lengths"),
        F.countDistinct("first_date").alias("distinct_starts"),
        F.countDistinct("last_date").alias("distinct_ends"),
        F.sum("duplicate_rows").alias("duplicate_rows"),
        F.sum("missing_values").alias("missing_values"),
    )


def row_histogram(audited: DataFrame) -> DataFrame:
    """How many tickers have how many rows."""
    return audited.groupBy("n_rows").agg(F.count("*").alias("n_tickers"))


def cutoff_violations(frame: DataFrame, *, as_of: str, available_at: str) -> DataFrame:
    """Rows whose information came after the moment they are used at; equal moments are fine."""
    required(frame, (as_of, available_at))
    moment = lambda c: F.expr(f"try_cast(`{c}` as timestamp)")
    return frame.where(moment(available_at) > moment(as_of))


def validate_cutoff(frame: DataFrame, *, as_of: str = "as_of_timestamp", available_at: str = "information_timestamp") -> None:
    moment = lambda c: F.expr(f"try_cast(`{c}` as timestamp)")
    if frame.where(moment(as_of).isNull() | moment(available_at).isNull()).take(1):
        raise ValueError("a timestamp cannot be read")
    if first := cutoff_violations(frame, as_of=as_of, available_at=available_at).take(1):
        raise ValueError(f"information after its cutoff, e.g. {first[0].asDict()}")
