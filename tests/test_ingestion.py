"""Saving again, checking while saving, and folds side by side."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from strandline.operators import quality
from strandline.plans import dataset, experiment
from strandline.plans.models import Baseline
from strandline.sources import panel, provider


def bars(spark, n=40, tickers=("AAA", "BBB")):
    rows = [(t, f"2024-01-{i % 28 + 1:02d}" if i < 28 else f"2024-02-{i - 27:02d}", 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 11.0 + i, 100.0) for t in tickers for i in range(n)]
    frame = spark.createDataFrame(rows, "ticker string, session_date string, open double, high double, low double, close double, adj_close double, volume double")
    return frame.withColumn("session_date", F.to_date("session_date"))


def rows_of(frame):
    return sorted(map(tuple, frame.select(*panel.COLUMNS).collect()))


# ------------------------------------------------------------------ universe


def provided(days, fails=(), first=1):
    def fetch(ticker, period):
        if ticker in fails:
            raise ConnectionError("down")
        return [{"Date": f"2024-01-{d:02d}", "Open": 10.0, "High": 12.0, "Low": 9.0, "Close": 11.0, "Adj Close": 11.0, "Volume": d} for d in range(first, days + 1)]

    return fetch


def test_a_second_run_replaces_and_a_failure_keeps_what_was_saved(spark, tmp_path):
    path = str(tmp_path / "u")
    read = lambda: sorted((r["ticker"], r["session_date"]) for r in spark.read.option("header", True).csv(path).collect())
    assert provider.fetch_universe(spark, provided(5), ["AAA", "BBB"], path) == (["AAA", "BBB"], {})
    once = read()
    assert len(once) == 10
    assert provider.fetch_universe(spark, provided(5), ["AAA", "BBB"], path) == (["AAA", "BBB"], {}) and read() == once
    fine, failed = provider.fetch_universe(spark, provided(7, fails=("BBB",), first=2), ["AAA", "BBB", "CCC"], path)
    assert fine == ["AAA", "CCC"] and list(failed) == ["BBB"]
    count = lambda t: sum(x == t for x, _ in read())
    assert (count("AAA"), count("BBB"), count("CCC")) == (6, 5, 6)
    assert provider.fetch_universe(spark, provided(0), ["AAA"], path)[0] == [] and count("AAA") == 6
    runs = spark.read.parquet(f"{path}/_runs").groupBy("run").agg(F.count("*").alias("n"), F.count("error").alias("failed")).collect()
    assert sorted((r["n"], r["failed"]) for r in runs) == [(1, 1), (2, 0), (2, 0), (3, 1)]
    assert not [p for p in (tmp_path / "u" / "_raw").iterdir() if p.is_dir()]


def ranged(log, last, fails=(), blind=False):
    """A provider of January days up to ``last`` that notes its calls in a folder; a blind one ignores the start."""

    def fetch(ticker, start, end):
        (log / f"{ticker} {start} {end} {uuid.uuid4().hex}").touch()
        if ticker in fails:
            raise ConnectionError("down")
        days = (f"2024-01-{d:02d}" for d in range(1, last + 1))
        return [{"Date": d, "Open": 10.0, "High": 12.0, "Low": 9.0, "Close": 11.0, "Adj Close": 11.0, "Volume": 5} for d in days if blind or (not start or d >= start) and (not end or d <= end)]

    return fetch


def calls(log):
    """Ticker, first and last day of the calls noted so far, which are forgotten."""
    out = sorted(tuple(p.name.split()[:3]) for p in log.iterdir())
    for p in log.iterdir():
        p.unlink()
    return out


def test_an_update_asks_only_for_days_that_are_not_saved(spark, tmp_path):
    path, log = str(tmp_path / "u"), tmp_path / "log"
    log.mkdir()
    read = lambda: sorted((r["ticker"], r["session_date"]) for r in spark.read.option("header", True).csv(path).collect())
    days = lambda t, n: [(t, f"2024-01-{d:02d}") for d in range(1, n + 1)]
    assert provider.update_universe(spark, ranged(log, 5), ["aaa", "007"], path) == (["007", "AAA"], {})
    assert calls(log) == [("007", "None", "None"), ("AAA", "None", "None")]
    assert provider.last_sessions(spark, path) == {"AAA": "2024-01-05", "007": "2024-01-05"}
    # A day later: one session of the known tickers, the whole history of a new one; a failure keeps what it has.
    fine, failed = provider.update_universe(spark, ranged(log, 6, fails=("007",)), ["AAA", "007", "CCC"], path)
    assert fine == ["AAA", "CCC"] and failed == {"007": "ConnectionError: down"}
    assert calls(log) == [("007", "2024-01-06", "None"), ("AAA", "2024-01-06", "None"), ("CCC", "None", "None")]
    # The failed ticker catches up; nothing new is no failure.
    assert provider.update_universe(spark, ranged(log, 6), ["AAA", "007", "CCC"], path) == (["007"], {})
    want = sorted(days("AAA", 6) + days("CCC", 6) + [("7", d) for _, d in days("007", 6)])
    assert sorted((t.lstrip("0"), d) for t, d in read()) == want
    # Days that are saved already are refused, and no file changes.
    fine, failed = provider.update_universe(spark, ranged(log, 7, blind=True), ["AAA", "DDD"], path)
    assert fine == ["DDD"] and failed == {"AAA": "not_after: 6"}
    assert [d for t, d in read() if t == "AAA"] == [d for _, d in days("AAA", 6)]
    # Nothing at all for a ticker that is not saved is a failure.
    assert provider.update_universe(spark, ranged(log, 0), ["EEE"], path) == ([], {"EEE": "ValueError: no rows"})
    # A run of whole histories makes one file a ticker again.
    assert provider.fetch_universe(spark, provided(6), ["AAA"], path) == (["AAA"], {})
    assert len(list((tmp_path / "u" / "of=AAA").glob("*.csv"))) == 1 and [d for t, d in read() if t == "AAA"] == [d for _, d in days("AAA", 6)]


def test_filters_reach_the_provider(spark, tmp_path):
    source = lambda **more: provider.scan_range(spark, ranged(tmp_path, 9, **more), ["AAA", "BBB", "CCC"])
    got = source().where("ticker = 'BBB' and session_date > '2024-01-03' and session_date <= '2024-01-05'").collect()
    assert [(r["ticker"], r["session_date"]) for r in got] == [("BBB", "2024-01-04"), ("BBB", "2024-01-05")]
    assert calls(tmp_path) == [("BBB", "2024-01-03", "2024-01-05")]
    assert source().where("ticker in ('AAA', 'CCC') and session_date = '2024-01-09'").count() == 2
    assert calls(tmp_path) == [("AAA", "2024-01-09", "2024-01-09"), ("CCC", "2024-01-09", "2024-01-09")]
    assert source().where("ticker = 'ZZZ'").count() == 0 and calls(tmp_path) == []
    assert source().where("session_date >= 'soon'").count() == 0
    assert [c[1:] for c in calls(tmp_path)] == [("None", "None")] * 3
    assert source(fails=("AAA",)).where("ticker <> 'BBB'").where("error is not null").count() == 1
    with pytest.raises(Exception, match="down"):
        source(fails=("AAA",)).where("session_date >= '2024-01-03'").count()


def test_saving_again_replaces(spark, tmp_path):
    frame = bars(spark)
    for save, read in ((panel.save_csv, lambda p: panel.normalise(panel.read_csv(spark, p))), (panel.save_parquet, spark.read.parquet)):
        path = str(tmp_path / save.__name__)
        save(frame, path)
        save(frame.where("ticker = 'AAA'"), path)
        assert rows_of(read(path)) == rows_of(frame.where("ticker = 'AAA'"))
    assert {p.name for p in (tmp_path / "save_parquet").iterdir() if p.is_dir()} == {"month=2024-01", "month=2024-02"}


# ------------------------------------------------------------------ checks inside a job


def test_validated_save_is_one_job_and_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    sc = spark.sparkContext
    sc.setJobGroup("validated", "one write")
    try:
        found = quality.save_validated(bars(spark).coalesce(1), path)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    # Adaptive execution submits the exchange as a job of its own; rows are written once.
    assert len(sc.statusTracker().getJobIdsForGroup("validated")) <= 2
    assert found["n_rows"] == 80 and not any(v for k, v in found.items() if k != "n_rows")
    assert rows_of(spark.read.parquet(path)) == rows_of(bars(spark))
    bad = bars(spark).withColumn("close", F.when(F.dayofmonth("session_date") == 3, -1.0).otherwise(F.col("close")))
    bad = bad.unionByName(bad.where(F.dayofmonth("session_date") == 5)).withColumn("ingest_id", -F.datediff("session_date", F.lit("2024-01-01")))
    with pytest.raises(ValueError) as error:
        quality.save_validated(bad, path)
    # February has days 3 and 5, too.
    assert all(x in str(error.value) for x in ("non_positive_close: 4", "ohlc_relation: 4", "duplicate_keys: 8", "unordered_rows"))
    assert rows_of(spark.read.parquet(path)) == rows_of(bars(spark))
    assert [p.name for p in tmp_path.iterdir()] == ["p"]
    assert quality.save_validated(bars(spark, 3), path)["n_rows"] == 6 and spark.read.parquet(path).count() == 6


def test_guards_inside_the_plan(spark):
    fine = bars(spark)
    guard = lambda frame: quality.guarded(frame, positive=("close", "volume"), ohlc=True)
    assert rows_of(guard(fine)) == rows_of(fine) and guard(fine).count() == 80
    for column, value in (("close", -1.0), ("close", None), ("volume", float("inf")), ("volume", float("nan"))):
        with pytest.raises(Exception, match="invalid panel"):
            guard(fine.withColumn(column, F.lit(value).cast("double"))).count()
    with pytest.raises(Exception, match="price relations"):
        guard(fine.withColumn("low", F.col("high") + 1)).count()
    with pytest.raises(Exception, match="null key"):
        guard(fine.withColumn("ticker", F.lit(None).cast("string"))).count()
    with pytest.raises(Exception, match="repeated"):
        guard(fine.unionByName(fine.limit(1))).count()


# ------------------------------------------------------------------ folds


def folds(spark):
    rows = spark.range(180).select(F.expr("if(id < 90, 'AAA', 'BBB')").alias("ticker"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 90).cast("int")).alias("session_date"), (F.col("id") % 90).cast("double").alias("f1"), (F.sin(F.col("id") % 90 / 5) / 100).alias("target_return_1d"))
    built = dataset.build_dataset(rows, feature_columns=["f1"], target_columns=["target_return_1d"])
    return experiment.walk_forward(built, min_train_sessions=40, val_sessions=10, step_sessions=15, target_horizon=1)


class Meeting(Baseline):
    """Fits only while another fold does."""

    gate = threading.Barrier(2)

    def fit(self, *args, **options):
        self.gate.wait(60)
        return super().fit(*args, **options)


def test_folds_overlap_and_are_scored_as_one_by_one(spark):
    parts = folds(spark)[:2]
    done = experiment.run_across_folds(lambda: Meeting("mean"), parts, "target_return_1d", side_by_side=2)
    alone = [experiment.train_and_validate(Baseline("mean"), b, "target_return_1d") for b in parts]
    for a, b in zip(done.folds, alone, strict=True):
        assert (a.fold_id, a.manifest_hash) == (b.fold_id, b.manifest_hash) and a.metrics.keys() == b.metrics.keys()
        assert all(a.metrics[k] == pytest.approx(b.metrics[k], nan_ok=True) or a.metrics[k] is b.metrics[k] for k in a.metrics)
    assert done.metrics["rmse"] == pytest.approx(sum(r.metrics["rmse"] for r in alone) / 2)
    assert [r["fold_id"] for r in done.scores.orderBy("fold_id").collect()] == [b.fold_id for b in parts]
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_a_failing_fold_ends_the_run(spark):
    class Failing(Baseline):
        def fit(self, *args, **options):
            raise RuntimeError("no fit")

    with pytest.raises(RuntimeError, match="no fit"):
        experiment.run_across_folds(lambda: Failing("zero"), folds(spark)[:2], "target_return_1d")
    kinds = iter(["zero", "mean"])
    with pytest.raises(RuntimeError, match="different models"):
        experiment.run_across_folds(lambda: Baseline(next(kinds)), folds(spark)[:2], "target_return_1d")
