from datetime import date

import pytest
from pyspark.sql import functions as F

from strandline.operators import scaling, splits
from strandline.plans import dataset, experiment, manifest
from strandline.plans.models import Baseline, Model
from tests.panels import frame, weekdays

TARGETS = ("target_return_1d", "target_return_5d", "target_up_1d", "target_up_5d")


def model_frame(spark, *tickers, n=120):
    base = frame(spark, *(tickers or ("AAA", "BBB")), n=n)
    i = F.dayofyear("session_date")
    up = (F.pmod(i, F.lit(3)) > 0).cast("double")
    return base.select("ticker", "session_date", F.col("close").alias("f1"), F.sin(i / 7).alias("f2"), (F.sin(i / 5) / 100).alias("target_return_1d"), (F.cos(i / 5) / 50).alias("target_return_5d"), up.alias("target_up_1d"), up.alias("target_up_5d"))


def built(spark, *tickers, n=120):
    return dataset.build_dataset(model_frame(spark, *tickers, n=n), feature_columns=("f1", "f2"), target_columns=TARGETS)


def test_chronological_parts_do_not_overlap_and_labels_stay_inside(spark):
    roles = splits.chronological_split(built(spark).rows, target_horizon=5)
    kept = {r["role"]: r for r in splits.split_counts(roles).collect()}
    assert (kept["train"]["n_raw"], kept["val"]["n_raw"], kept["test"]["n_raw"]) == (84 * 2, 18 * 2, 18 * 2)
    assert kept["train"]["n_purged"] == kept["val"]["n_purged"] == 10 and kept["test"]["n_purged"] == 0
    assert kept["train"]["last_date"] < kept["val"]["first_date"] < kept["val"]["last_date"] < kept["test"]["first_date"]


def test_embargo_takes_the_head_of_the_test_part(spark):
    roles = splits.chronological_split(built(spark).rows, target_horizon=1, embargo_sessions=3)
    assert roles.where("status = 'embargoed'").select("role").distinct().collect()[0]["role"] == "test"
    assert roles.where("status = 'embargoed'").count() == 6


def test_walk_forward_embargo_comes_before_purging():
    folds = splits.walk_forward_folds(140, min_train_sessions=60, val_sessions=20, step_sessions=30, embargo_sessions=5)
    assert [f.train for f in folds] == [(0, 60), (0, 90), (0, 120)]
    assert folds[1].embargo == (80, 85) and folds[0].embargo is None
    assert splits.walk_forward_folds(140, min_train_sessions=60, val_sessions=20, expanding=False)[1].train == (20, 80)


def test_embargoed_rows_are_skipped_by_labels(spark):
    rows = splits.with_sessions(built(spark, "AAA").rows)
    folds = splits.walk_forward_folds(120, min_train_sessions=60, val_sessions=20, step_sessions=30, embargo_sessions=5)
    got = {(r["fold_id"], r["role"]): r for r in splits.split_counts(splits.assign_roles(rows, folds, horizon=5)).collect()}
    assert got[1, "train"]["n_embargoed"] == 5 and got[1, "train"]["n_purged"] == 5
    assert got[1, "val"]["n_purged"] == 5


@pytest.mark.parametrize("n", [1, 2])
def test_too_few_sessions(n):
    with pytest.raises(ValueError):
        splits.chronological_fold(n)


def test_three_sessions_fail_clearly():
    with pytest.raises(ValueError, match="too few"):
        splits.chronological_fold(3)


@pytest.mark.parametrize("options", [{"train_ratio": 0.9}, {"val_ratio": 0.0, "train_ratio": 0.85}, {"target_horizon": 0}])
def test_chronological_arguments(options):
    with pytest.raises(ValueError):
        splits.chronological_fold(100, **options)


@pytest.mark.parametrize("options", [{"step_sessions": 5}, {"val_sessions": 0}, {"min_train_sessions": 200}])
def test_walk_forward_arguments(options):
    with pytest.raises(ValueError):
        splits.walk_forward_folds(140, **options)


def test_inner_selection_geometry(spark):
    rows = splits.with_sessions(built(spark, "AAA", n=30).rows)
    roles = splits.assign_roles(rows, [splits.inner_selection_fold(30)], horizon=5)
    got = {r["role"]: r for r in splits.split_counts(roles).collect()}
    assert got["val"]["n_raw"] == 6 and got["train"]["n_kept"] == 19 and got["train"]["n_purged"] == 5


def test_purge_protect_embargo_on_subsets(spark):
    rows = frame(spark, "A", n=10).select("ticker", "session_date")
    days = weekdays(10)
    subset = rows.where(F.col("session_date") < F.lit(days[8]))
    assert splits.purge_train_horizon(subset, val_start=days[8], horizon=2).count() == 6
    assert splits.protect_validation_horizon(subset, test_start=None, horizon=2).count() == 8
    assert splits.apply_embargo(rows, rows, start=days[3], sessions=2).count() == 8
    outcome = {r["session_date"]: r["outcome_date"] for r in splits.label_outcome_dates(rows, 3).collect()}
    assert outcome[days[0]] == days[3] and outcome[days[9]] is None


def test_scaler_uses_training_rows_only(spark):
    data = built(spark)
    parameters = lambda d: experiment.chronological(d, target_horizon=1)[0].train.agg(F.avg("f1"), F.stddev_pop("f1")).first()
    mean, deviation = parameters(data)
    assert abs(mean) < 1e-9 and abs(deviation - 1) < 1e-9
    late = data.with_rows(data.rows.withColumn("f1", F.when(F.col("session_date") > F.lit(date(2020, 5, 5)), F.col("f1") * 100).otherwise(F.col("f1"))))
    assert experiment.chronological(late, target_horizon=1)[0].train.agg(F.max("f1")).first() == experiment.chronological(data, target_horizon=1)[0].train.agg(F.max("f1")).first()


def test_scaler_contract(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "f1 double, f2 double")
    s = scaling.TrainOnlyScaler().fit(rows, ["f1", "f2"])
    assert s.parameters["f2"] == (5.0, 1.0) and abs(s.parameters["f1"][1] - (2 / 3) ** 0.5) < 1e-12
    with pytest.raises(RuntimeError):
        s.fit(rows, ["f1"])
    with pytest.raises(ValueError):
        s.transform(rows, ["f2", "f1"])
    with pytest.raises(RuntimeError):
        scaling.TrainOnlyScaler().transform(rows, ["f1"])
    robust = scaling.TrainOnlyScaler("robust").fit(rows, ["f1"])
    assert robust.parameters["f1"] == (2.0, 1.0)
    with pytest.raises(ValueError):
        scaling.TrainOnlyScaler("other")


def test_dataset_contract(spark):
    base = model_frame(spark, "AAA", n=10)
    for features, targets in ((("f1", "f1"), TARGETS), (("target_return_1d",), TARGETS), (("missing",), TARGETS), ((), TARGETS), (("f1",), ("f1",))):
        with pytest.raises(ValueError):
            dataset.build_dataset(base, feature_columns=features, target_columns=targets)
    with pytest.raises(ValueError, match="infinite"):
        dataset.build_dataset(base.withColumn("f1", F.lit(float("inf"))), feature_columns=("f1",), target_columns=("target_return_1d",))
    with pytest.raises(ValueError, match="repeated"):
        dataset.build_dataset(base.unionByName(base), feature_columns=("f1",), target_columns=("target_return_1d",))
    with pytest.raises(ValueError, match="no complete"):
        dataset.build_dataset(base.withColumn("f1", F.lit(float("nan"))), feature_columns=("f1",), target_columns=("target_return_1d",))
    ids = [r["row_id"] for r in built(spark).rows.orderBy("session_date", "ticker").collect()]
    assert ids == list(range(240))


def test_target_specs():
    assert dataset.target_spec("target_up_5d") == dataset.TargetSpec("target_up_5d", "classification", 5)
    for name in ("target_return_20d", "target_x_1d", "close"):
        with pytest.raises(ValueError):
            dataset.target_spec(name)


def test_sequences(spark):
    rows = built(spark, "A", "B", n=12).rows
    got = dataset.lookback_sequences(rows, ("f1", "f2"), lookback=3, max_lookback=5)
    assert got.count() == 2 * 8
    assert got.select(F.size("sequence")).distinct().collect()[0][0] == 3
    own = {r["session_date"]: r["f1"] for r in rows.where("ticker = 'A'").collect()}
    days = sorted(own)
    row = got.where((F.col("ticker") == "A") & (F.col("session_date") == F.lit(days[6]))).first()
    assert [v[0] for v in row["sequence"]] == [own[d] for d in days[4:7]]
    with pytest.raises(ValueError):
        dataset.lookback_sequences(rows, ("f1",), lookback=5, max_lookback=3)


def test_bundles_have_no_test_rows_and_the_gate_holds(spark):
    bundle, test = experiment.chronological(built(spark), target_horizon=5)
    assert not any("test" in name for name in vars(bundle)) and test.rows.count() == 36
    gate = experiment.ValidationGate(bundle)
    with pytest.raises(experiment.NotFrozen):
        gate.open()
    with pytest.raises(experiment.NotOpen):
        gate.freeze().bundle()
    opened = gate.freeze().open()
    assert opened.bundle() is bundle
    with pytest.raises(RuntimeError):
        opened.freeze()


def test_manifests_are_deterministic_and_sensitive(spark):
    one = experiment.chronological(built(spark), target_horizon=5)[0].manifest
    two = experiment.chronological(built(spark), target_horizon=5)[0].manifest
    other = experiment.chronological(built(spark), target_horizon=1)[0].manifest
    assert one == two and one.manifest_hash != other.manifest_hash and one.to_json() == two.to_json()
    assert manifest.index_hash([3, 1, 2]) == manifest.index_hash([1, 2, 3]) != manifest.index_hash([1, 2])


def test_experiment_over_folds(spark):
    folds = experiment.walk_forward(built(spark, n=110), min_train_sessions=60, val_sessions=20, target_horizon=1)
    assert len(folds) == 2
    zero, mean = (experiment.run_across_folds(lambda s=s: Baseline(s), folds, "target_return_1d") for s in ("zero", "mean"))
    board = experiment.compare(spark, [mean, zero])
    assert [r["model"] for r in board.collect()] == sorted(("baseline_zero", "baseline_mean"), key=lambda m: ({"baseline_zero": zero, "baseline_mean": mean}[m].metrics["rmse"], m))
    with pytest.raises(ValueError):
        experiment.compare(spark, [zero], primary_metric="nothing")
    with pytest.raises(ValueError):
        experiment.run_across_folds(lambda: Baseline("zero"), [], "target_return_1d")
    with pytest.raises(TypeError):
        experiment.run_across_folds(lambda: object(), folds, "target_return_1d")
    used = Baseline("zero")
    with pytest.raises(RuntimeError):
        experiment.run_across_folds(lambda: used, folds, "target_return_1d")


def test_outer_validation_never_reaches_fit(spark):
    seen = []

    class Spy(Model):
        name, selects = "spy", True

        def fit(self, rows, features, spec, selection=None, history=None):
            self.begin(rows, features, spec)
            seen.append((rows, selection))
            return self

        def predict(self, rows, history=None):
            return rows.withColumn("y_pred", F.lit(0.0))

    bundle, _ = experiment.chronological(built(spark), target_horizon=5)
    result = experiment.train_and_validate(Spy(), bundle, "target_return_5d")
    first_val = bundle.val.agg(F.min("session_date")).first()[0]
    for part in seen[0]:
        assert part.agg(F.max("session_date")).first()[0] < first_val
    assert seen[0][0].agg(F.max("session_date")).first()[0] < seen[0][1].agg(F.min("session_date")).first()[0]
    assert result.metrics["rmse"] > 0
