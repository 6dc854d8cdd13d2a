"""Registered queries of the panel engine, over panels derived from the test tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import context, metrics, prices, technical
from strandline.operators import joins, quality, scaling, splits
from strandline.plans import dataset, experiment, search
from strandline.session import scratch, ship
from strandline.sources import panel
from strandline.streaming.bars import event_bars as bars_of_events

Query = Callable[[SparkSession, str], DataFrame]

KEYS = ("ticker", "session_date")
FEATURES = ("log_return_1d", "volatility_20d", "volume_change_1d", "close_to_sma_20")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return panel.bars_from_trades(spark, d)


def _series(spark: SparkSession, d: str, priority: str | None = None) -> DataFrame:
    """A daily series as an index: a divisor of 3.7, as indices have one, which also keeps window means
    off the half-way points of rounding, where engines differ."""
    return panel.daily_series(spark, d, priority).withColumn("close", F.col("close") / 3.7)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d)


def _once(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder, for queries that read it more than once."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _pick(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Keys as they are, values rounded, so that engines agree on accumulated sums."""
    return frame.select(*KEYS, *(F.round(c, digits).alias(c) for c in columns))


def _dataset_frame(spark: SparkSession, d: str) -> DataFrame:
    out = prices.targets(prices.volatility_volume_features(prices.return_features(_bars(spark, d))))
    return technical.moving_averages(out, (20,))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    frame = _dataset_frame(spark, d).select(*KEYS, *FEATURES, "target_return_1d", "target_return_5d", "target_up_1d", "target_up_5d")
    return frame.na.drop("any")


def bars(spark, d):
    return _bars(spark, d)


def csv_round_trip(spark, d):
    """Bars written as CSV files with the provider's ways (names, times, blanks), then read, checked and brought in order."""
    b = _bars(spark, d)
    names = {v: k for k, v in panel.PROVIDER_NAMES.items()}
    sent = b.select(F.concat(F.date_format("session_date", "yyyy-MM-dd"), F.lit(" 00:00:00")).alias("session_date"), F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")).alias("ticker"), *panel.NUMERIC)
    path = scratch(spark, "csv")
    for _ in range(2):  # saving again replaces
        panel.save_csv(sent, path)
    read = panel.read_csv(spark, path)
    quality.validate(read.drop("ingest_id"))
    renamed = read.select(*(F.col(c).alias(names.get(c, c)) for c in panel.COLUMNS))
    return _pick(panel.normalise(renamed), *panel.NUMERIC)


def wide_frames(spark, d):
    """One column a field and ticker, as providers send several tickers at once, made long again."""
    b = _bars(spark, d)
    tickers = [r[0] for r in b.select("ticker").distinct().orderBy("ticker").limit(100).collect()]  # brands: 25 at most
    cells = [F.max(F.when(F.col("ticker") == t, F.col(c))).alias(f"{c}|{t}") for t in tickers for c in panel.NUMERIC]
    long = panel.normalise(panel.wide_to_long(b.groupBy("session_date").agg(*cells)))
    return _pick(long.where("close is not null"), *panel.NUMERIC)


def validated_save(spark, d):
    """Bars checked and saved in one job, as they are read back."""
    path = scratch(spark, "panel")
    quality.save_validated(_bars(spark, d), path)
    return _pick(spark.read.parquet(path), *panel.NUMERIC)


def faulty_panel(spark: SparkSession, d: str) -> DataFrame:
    """Bars with planted faults, so that the report has something to count."""
    b, day = _bars(spark, d), F.dayofmonth("session_date")
    b = b.withColumns(
        {
            "volume": F.when(day == 7, -F.col("volume")).otherwise(F.col("volume")),
            "adj_close": F.when(day == 9, 0.0).when(day == 10, F.lit(None)).otherwise(F.col("adj_close")),
            "low": F.when(day == 13, F.col("high") + 1).otherwise(F.col("low")),
            "open": F.when(day == 15, F.lit(float("inf"))).otherwise(F.col("open")),
            "ticker": F.when((day == 21) & (F.col("ticker") == "Brand#11"), "  ").otherwise(F.col("ticker")),
        }
    )
    return b.unionByName(b.where(F.dayofmonth("session_date") == 28))


def quality_report(spark, d):
    return quality.quality_report(faulty_panel(spark, d)).drop("unordered_tickers")


def order_report(spark, d):
    """Order of days as rows came in: the tickers with an odd number came backwards."""
    number, days = F.regexp_extract("ticker", r"(\d+)", 1).cast("int"), F.datediff("session_date", F.lit("1970-01-01"))
    came = _bars(spark, d).withColumn("ingest_id", F.when(number % 2 == 1, -days).otherwise(days))
    return quality.quality_report(came).select("n_rows", "duplicate_keys", "unordered_tickers")


def repeated_keys(spark, d):
    return joins.repeated_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_partkey", "l_suppkey", "l_quantity"])


def audit_by_ticker(spark, d):
    return quality.audit(_bars(spark, d))


def audit_totals(spark, d):
    return quality.audit_totals(quality.audit(_bars(spark, d)))


def audit_row_histogram(spark, d):
    return quality.row_histogram(quality.audit(_bars(spark, d)))


def log_returns(spark, d):
    return _pick(prices.return_features(_bars(spark, d)), *(f"log_return_{h}d" for h in prices.HORIZONS))


def price_shape(spark, d):
    return _pick(prices.return_features(_bars(spark, d)), "intraday_return", "overnight_gap", "high_low_range")


def targets(spark, d):
    return _pick(prices.targets(_bars(spark, d)), "target_return_1d", "target_return_5d", "target_up_1d", "target_up_5d")


def volatility(spark, d):
    return _pick(prices.volatility_volume_features(_bars(spark, d)), "volatility_5d", "volatility_20d", "volatility_60d")


def volume_features(spark, d):
    return _pick(prices.volatility_volume_features(_bars(spark, d)), "volume_change_1d", "volume_sma_5d", "volume_zscore_5d", "volume_sma_20d", "volume_zscore_20d")


def sma_ratios(spark, d):
    return _pick(technical.moving_averages(_bars(spark, d)), *(f"sma_{n}" for n in technical.SMA_WINDOWS), *(f"close_to_sma_{n}" for n in technical.SMA_WINDOWS))


def bollinger(spark, d):
    return _pick(technical.bollinger(_bars(spark, d)), "bb_percent_b_20_2", "bb_bandwidth_20_2")


def trend_slope(spark, d):
    return _pick(technical.trend_slope(_bars(spark, d)), "trend_slope_20", "trend_slope_50")


def stochastic(spark, d):
    return _pick(technical.stochastic(_bars(spark, d)), "stoch_k_14", "stoch_d_14_3")


def ema(spark, d):
    return _pick(technical.exponential_averages(_bars(spark, d)), "ema_10", "ema_20", "ema_50")


def macd(spark, d):
    return _pick(technical.macd(_bars(spark, d)), "macd_12_26", "macd_signal_9", "macd_hist_12_26_9")


def rsi(spark, d):
    return _pick(technical.rsi(_bars(spark, d)), "rsi_14")


def dmi_adx(spark, d):
    return _pick(technical.directional_movement(_bars(spark, d)), "plus_di_14", "minus_di_14", "di_spread_14", "adx_14")


def technical_all(spark, d):
    return _pick(technical.technical_features(_bars(spark, d)), *technical.COLUMNS)


#: Shorter than the panel's histories, so that they are cut.
SLICE_ROWS = 500


def technical_sliced(spark, d):
    """As ``technical_all``, by slices of time in place of tickers."""
    return _pick(technical.technical_features(_bars(spark, d), slice_rows=SLICE_ROWS), *technical.COLUMNS)


def prices_sliced(spark, d):
    """Volatility and targets by slices of time: windows that look back and ahead over their edges."""
    out = prices.price_features(_bars(spark, d), slice_rows=SLICE_ROWS)
    return _pick(out, "volatility_5d", "volatility_20d", "volatility_60d", "target_return_1d", "target_return_5d", "target_up_1d", "target_up_5d")


def market_context(spark, d):
    out = context.market_context(panel.with_sector(_bars(spark, d)), market_index=_index(spark, d))
    return _pick(out, *context.MARKET_COLUMNS)


def context_returns(spark, d):
    out = context.market_context(panel.with_sector(_bars(spark, d)), market_index=_index(spark, d))
    return _pick(out, *(f"stock_return_{n}d_context" for n in context.SPANS))


def market_regime(spark, d):
    return context.regime(context.index_features(_index(spark, d))).select("session_date", *context.REGIME_COLUMNS)


def market_regime_blocks(spark, d):
    """As ``market_regime``, with slices and blocks of time in place of one growing window."""
    index = context.index_features(_index(spark, d), slice_rows=SLICE_ROWS)
    return context.regime(index, blocks=8).select("session_date", *context.REGIME_COLUMNS)


def sector_context(spark, d):
    return _pick(context.sector_context(panel.with_sector(_bars(spark, d))), *context.SECTOR_COLUMNS)


def cross_asset(spark, d):
    out = context.cross_asset_context(_bars(spark, d), india_vix=_series(spark, d, "1-URGENT"), usd_inr=_series(spark, d, "2-HIGH"))
    return _pick(out, *context.CROSS_ASSET_COLUMNS)


def context_all(spark, d):
    """Each table is read once: bars and the four daily series, a row a day, are written down."""
    kinds = {"market_index": None, "india_vix": "1-URGENT", "usd_inr": "2-HIGH", "crude": "5-LOW"}
    days = _once(panel.daily_series_of(spark, d, kinds), "series")
    series = {name: days.where(F.col(name).isNotNull()).select("session_date", (F.col(name) / 3.7).alias("close")) for name in kinds}
    out = context.context_features(panel.with_sector(_once(_bars(spark, d), "bars")), **series)
    return _pick(out, *context.ALL_COLUMNS)


def information_cutoff_violations(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    both = items.join(orders, items.l_orderkey == orders.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("as_of_timestamp"), F.col("o_orderdate").alias("information_timestamp"))
    late = quality.cutoff_violations(both, as_of="as_of_timestamp", available_at="information_timestamp")
    return late.select("l_orderkey", "l_linenumber", "l_partkey")


def model_dataset(spark, d):
    built = dataset.build_dataset(_dataset_frame(spark, d), feature_columns=FEATURES, target_columns=("target_return_1d", "target_up_1d"))
    return _pick(built.rows, *FEATURES, "target_return_1d", "target_up_1d", "row_id")


def label_outcome_dates(spark, d):
    return splits.label_outcome_dates(_bars(spark, d), 5).select(*KEYS, "outcome_date")


def chronological_roles(spark, d):
    roles = splits.chronological_split(_clean(spark, d), target_horizon=5, embargo_sessions=3)
    return roles.select(*KEYS, "role", "status")


def walk_forward_folds(spark, d):
    roles = splits.walk_forward_split(_clean(spark, d), min_train_sessions=600, val_sessions=200, step_sessions=250, target_horizon=5, embargo_sessions=10)
    return splits.split_counts(roles)


def walk_forward_rolling(spark, d):
    roles = splits.walk_forward_split(_clean(spark, d), min_train_sessions=400, val_sessions=300, target_horizon=1, expanding=False)
    return splits.split_counts(roles)


def purge_counts(spark, d):
    roles = splits.walk_forward_split(_clean(spark, d), min_train_sessions=1000, val_sessions=400, target_horizon=5)
    return roles.where("status = 'purged'").groupBy("fold_id", "role", "ticker").agg(F.count("*").alias("n_purged"))


def inner_folds(spark, d):
    return splits.split_counts(splits.inner_folds(_clean(spark, d), target_horizon=5))


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return splits.walk_forward_split(_clean(spark, d), min_train_sessions=1000, val_sessions=400, target_horizon=5)


def _scaled(spark: SparkSession, d: str, kind: str, **options) -> DataFrame:
    train = _roles(spark, d).where("status = 'kept' and role = 'train'")
    fitted = scaling.fit_by(train, FEATURES, kind=kind, **options)
    return fitted.select("fold_id", *(F.round(c, 6).alias(c) for c in fitted.columns if c != "fold_id"))


def scaler_standard(spark, d):
    return _scaled(spark, d, "standard")


def scaler_robust(spark, d):
    return _scaled(spark, d, "robust")


def scaler_robust_selected(spark, d):
    """As ``scaler_robust``, by radix selection, as larger folds have it."""
    return _scaled(spark, d, "robust", buffered_rows=0)


def scaled_validation(spark, d):
    kept = _roles(spark, d).where("status = 'kept'")
    out = scaling.scale_by(kept.where("role = 'val'"), scaling.fit_by(kept.where("role = 'train'"), FEATURES), FEATURES)
    return out.select(*KEYS, "fold_id", *(F.round(f, 6).alias(f) for f in FEATURES))


def lookback_sequences(spark, d):
    out = dataset.lookback_sequences(_clean(spark, d), ("log_return_1d", "volume_change_1d"), lookback=5, max_lookback=10)
    text = F.concat_ws(";", F.transform("sequence", lambda v: F.concat_ws(",", F.transform(v, lambda x: F.round(x * 1000, 0).cast("long").cast("string")))))
    return out.select(*KEYS, text.alias("sequence"))


def sequence_values(spark, d):
    """The vectors a sequence model reads, to six decimals."""
    out = dataset.lookback_sequences(_clean(spark, d), ("log_return_1d", "volume_change_1d"), lookback=10, max_lookback=20)
    text = F.concat_ws(";", F.transform("sequence", lambda v: F.concat_ws(",", F.transform(v, lambda x: F.round(x * 1000000, 0).cast("long").cast("string")))))
    return out.select(*KEYS, text.alias("sequence"))


def _folds(spark: SparkSession, d: str) -> list[experiment.FoldBundle]:
    built = dataset.build_dataset(_dataset_frame(spark, d), feature_columns=FEATURES, target_columns=("target_return_5d",))
    return experiment.walk_forward(built, min_train_sessions=1000, val_sessions=400, target_horizon=5)


def split_manifest(spark, d):
    """What identifies each fold: counts, bounds, and a digest of its rows."""
    columns = ["fold_id", *(f"n_{role}_{k}" for role in ("train", "val") for k in ("raw", "purged", "final")), "n_test", "train_index_hash", "val_index_hash"]
    rows = [(*(getattr(b.manifest, c) for c in columns), *b.manifest.train_date_bounds, *b.manifest.val_date_bounds) for b in _folds(spark, d)]
    kinds = "fold_id int, " + ", ".join(f"{c} {'string' if c.endswith('hash') else 'long'}" for c in columns[1:])
    return spark.createDataFrame(rows, f"{kinds}, train_first string, train_last string, val_first string, val_last string")


def prepared_folds(spark, d):
    """Rows of each fold's parts, and its validation features on the scale of its training rows."""
    parts = []
    for b in _folds(spark, d):
        sizes = b.train.agg(F.count("*").alias("n_train")).crossJoin(F.broadcast(b.context_raw.agg(F.count("*").alias("n_context"))))
        means = b.val.agg(F.count("*").alias("n_val"), *(F.round(F.avg(f), 6).alias(f) for f in b.features))
        # One row each.
        parts.append(sizes.crossJoin(F.broadcast(means)).withColumn("fold_id", F.lit(b.fold_id)))
    return experiment.union_all(parts)


def gated_validation(spark, d):
    """Validation rows as the gate hands them out, once the configuration is frozen."""
    opened = [experiment.ValidationGate(b).freeze().open().bundle() for b in _folds(spark, d)]
    return experiment.union_all([b.val.select(*KEYS, F.lit(b.fold_id).alias("fold_id"), *(F.round(f, 6).alias(f) for f in b.features)) for b in opened])


def inner_selection(spark, d):
    """The holdout inside each fold's training rows on which a model chooses its iteration."""
    spec, parts = dataset.target_spec("target_return_5d"), []
    for b in _folds(spark, d):
        fit, held, before = experiment.inner_holdout(b.train, spec)
        n = fit.agg(F.count("*").alias("fit_count")).crossJoin(F.broadcast(before.agg(F.count("*").alias("raw_count"))))
        # One row each.
        n = n.crossJoin(F.broadcast(held.agg(F.count("*").alias("selection_count"), F.min("session_date").alias("selection_start"))))
        parts.append(n.withColumn("fold_id", F.lit(b.fold_id)))
    return experiment.union_all(parts)


def inner_fold_geometry(spark, d):
    """The search protocol's two inner folds inside each fold's training rows."""
    names = ("raw_fit_count", "purged_fit_count", "selection_count", "selection_start")
    rows = [(b.fold_id, f.fold_id, *(f.geometry[k] for k in names)) for b in _folds(spark, d) for f in experiment.inner_folds(b, target_horizon=5)]
    return spark.createDataFrame(rows, "fold_id int, inner_fold int, raw_fit_count long, purged_fit_count long, selection_count long, selection_start string")


def experiment_baselines(spark, d):
    """Baselines over all folds, as the runner does it for any model: trained side by side, scored together."""
    from strandline.plans.models import Baseline

    folds = _folds(spark, d)
    done = [experiment.run_across_folds(lambda s=strategy: Baseline(s), folds, "target_return_5d") for strategy in ("zero", "mean")]
    # A rounded -0.0 becomes 0.0.
    return experiment.union_all([e.scores for e in done]).select("model", "fold_id", *((F.round(m, 6) + 0.0).alias(m) for m in metrics.REGRESSION))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """A simple per-row predictor, so that metrics have varied inputs: minus a tenth of the last return."""
    kept = _roles(spark, d).where("status = 'kept' and role = 'val'")
    return kept.select(*KEYS, "fold_id", F.col("target_return_5d").alias("y_true"), (F.col("log_return_1d") * -0.1).alias("y_pred"), F.col("target_up_5d").alias("up"), (1 / (1 + F.exp(F.col("log_return_1d") * 2))).alias("p1"))


def baseline_predictions(spark, d):
    out = experiment.baseline_predictions(_roles(spark, d), "target_return_5d", "mean")
    ups = experiment.baseline_predictions(_roles(spark, d), "target_up_5d", "majority").select("fold_id", *KEYS, "p1")
    return out.join(ups, ["fold_id", *KEYS]).select(*KEYS, "fold_id", F.round("y_pred", 6).alias("y_pred"), F.round("p1", 6).alias("p1"))


def regression_metrics(spark, d):
    out = metrics.regression_metrics(_predicted(spark, d), ("fold_id", "ticker"))
    return out.select("fold_id", "ticker", "n", *(F.round(m, 6).alias(m) for m in metrics.REGRESSION))


def classification_metrics(spark, d):
    out = metrics.classification_metrics(_predicted(spark, d), ("fold_id", "ticker"), y="up")
    return out.select("fold_id", "ticker", "n", *(F.round(m, 6).alias(m) for m in metrics.CLASSIFICATION))


def macro_objective(spark, d):
    out = metrics.macro_objective(_predicted(spark, d), "regression")
    return out.select(F.round("objective", 6).alias("objective"), "n_folds")


def experiment_leaderboard(spark, d):
    """Three models over the folds in one job: their predictions stand side by side."""
    base = _predicted(spark, d)
    kinds = {"reversal": F.col("y_pred"), "momentum": -F.col("y_pred"), "zero": F.lit(0.0)}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), c.alias("y_pred")) for m, c in kinds.items())))
    models = base.select("fold_id", "y_true", each.alias("k")).select("fold_id", "y_true", "k.*")
    means = experiment.fold_means(metrics.regression_metrics(models, ("model", "fold_id")), metrics.REGRESSION)
    board = experiment.leaderboard(means, primary_metric="rmse")
    return board.select("model", *(F.round(m, 6).alias(m) for m in metrics.REGRESSION))


def event_bars(spark, d):
    out = bars_of_events(spark.read.parquet(f"{d}/events.parquet"))
    return out.select("ticker", F.col("window_start").cast("date").alias("session_date"), "open", "high", "low", "close", "volume")


def panel_summary(spark, d):
    """The flagship: scan, join, bars, windowed features, summary by ticker."""
    b = prices.volatility_volume_features(prices.return_features(_bars(spark, d)))
    return b.groupBy("ticker").agg(
        F.count("*").alias("n_sessions"), F.count("volatility_20d").alias("n_volatility"), F.round(F.avg("log_return_1d"), 6).alias("mean_return"), F.round(F.avg("volatility_20d"), 6).alias("mean_volatility"), F.max("high").alias("top"), F.sum("volume").alias("volume")
    )


def gbt_predictions(spark, d):
    """Boosted trees of every fold, as the operator's defaults have them, chosen on each fold's inner holdout."""
    from strandline.plans.models import BoostedTrees

    spec = dataset.target_spec("target_return_1d")
    kept = _roles(spark, d).where("status = 'kept'").select(*KEYS, *FEATURES, spec.name, "fold_id", "role")
    kept, predicted = _once(kept, "folds"), []
    for (fold_id,) in sorted(kept.select("fold_id").distinct().collect()):
        fold = kept.where(F.col("fold_id") == fold_id)
        fit, held, _ = experiment.inner_holdout(fold.where("role = 'train'").drop("fold_id", "role"), spec)
        model = BoostedTrees().fit(fit, FEATURES, spec, held)
        predicted.append(model.predict(fold.where("role = 'val'")).select(*KEYS, "fold_id", "y_pred"))
    return experiment.union_all(predicted)


def search_trials(spark, d):
    """The sampler on the protocol's inner folds: how much of the last return to predict back.

    The error of that one-parameter model follows from each fold's second moments, so one
    aggregate over the selection rows serves all trials.
    """
    y, x = F.col("target_return_5d"), F.col("log_return_1d")
    kept = splits.inner_folds(_clean(spark, d), target_horizon=5).where("role = 'val' and status = 'kept'")
    moments = kept.groupBy("fold_id").agg(F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy"), F.avg(x * x).alias("xx")).collect()  # two folds

    def relative_rmse(trial) -> float:
        k = trial.params["learning_rate"]
        return metrics.finite_mean([math.sqrt((m["yy"] + 2 * k * m["xy"] + k * k * m["xx"]) / m["yy"]) for m in moments], label="relative_rmse")

    study = search.Study("reversal", search.space("XGBoost")["parameters"])
    study.optimise(relative_rmse, 30)
    search.validate_study(study)
    return search.trials_frame(spark, study)


def _plain(query: Query) -> Query:
    """Days as text, which engines show alike."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        out = query(spark, d)
        return out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "date"})

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES: dict[str, Query] = {
    f.__name__: _plain(f)
    for f in (
        panel_summary, bars, csv_round_trip, wide_frames, validated_save, quality_report, audit_by_ticker, audit_totals, audit_row_histogram, log_returns, price_shape, targets, volatility, volume_features, sma_ratios, bollinger, trend_slope, stochastic, ema, macd, rsi, dmi_adx,
        technical_all, technical_sliced, prices_sliced, market_context, market_regime, market_regime_blocks, sector_context, cross_asset, context_all, information_cutoff_violations, model_dataset, label_outcome_dates, chronological_roles, walk_forward_folds, walk_forward_rolling, purge_counts,
        inner_folds, inner_selection, inner_fold_geometry, split_manifest, prepared_folds, gated_validation, experiment_baselines, order_report, repeated_keys, context_returns, sequence_values, scaler_standard, scaler_robust, scaler_robust_selected, scaled_validation, lookback_sequences, baseline_predictions, regression_metrics, classification_metrics, macro_objective, experiment_leaderboard, event_bars, gbt_predictions, search_trials,
    )
}
