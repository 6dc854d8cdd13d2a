import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import metrics
from strandline.plans import experiment, manifest, models, networks, search
from strandline.plans.autodiff import Value
from strandline.plans.protocol import run_protocol
from strandline.sources import synthetic
from tests.test_splits import built


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(0.1, 0.2), (-0.2, -0.1), (0.3, -0.1), (float("nan"), 1.0)], "y_true double, y_pred double")
    got = metrics.regression_metrics(rows).first()
    y, p = np.array([0.1, -0.2, 0.3]), np.array([0.2, -0.1, -0.1])
    assert got["n"] == 3 and math.isclose(got["rmse"], np.sqrt(np.mean((y - p) ** 2))) and math.isclose(got["mae"], np.mean(abs(y - p)))
    assert math.isclose(got["relative_rmse"], got["rmse"] / np.sqrt(np.mean(y * y))) and math.isclose(got["directional_accuracy"], 2 / 3)
    assert math.isclose(got["r2"], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and math.isclose(got["pearson_ic"], np.corrcoef(y, p)[0, 1])


def test_metrics_of_constants_and_of_nothing(spark):
    same = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y_true double, y_pred double")
    got = metrics.regression_metrics(same).first()
    assert (got["r2"], got["pearson_ic"], got["relative_rmse"]) == (0.0, 0.0, None)
    empty = metrics.regression_metrics(same.limit(0)).first()
    assert empty["n"] == 0 and all(empty[m] is None for m in metrics.REGRESSION)


def test_classification_metrics(spark):
    rows = spark.createDataFrame([(1.0, 0.9), (0.0, 0.6), (1.0, 0.2), (0.0, 0.0)], "y_true double, p1 double")
    got = metrics.classification_metrics(rows).first()
    want = -np.mean([math.log(0.9), math.log(0.4), math.log(0.2), math.log(1 - 1e-15)])
    assert math.isclose(got["logloss"], want, rel_tol=1e-9) and (got["accuracy"], got["precision"], got["recall"], got["f1"]) == (0.5, 0.5, 0.5, 0.5)
    for bad in ((2.0, 0.5), (1.0, float("nan"))):
        with pytest.raises(Exception, match="targets must be"):
            metrics.classification_metrics(spark.createDataFrame([bad], "y_true double, p1 double")).collect()


@pytest.mark.parametrize("values", [[], [1.0, math.nan], [math.inf]])
def test_finite_mean(values):
    with pytest.raises(search.InvalidTrial):
        metrics.finite_mean(values, label="x")
    assert metrics.finite_mean([1.0, 3.0], label="x") == 2.0


def test_baselines(spark):
    rows = built(spark, n=20).rows
    from strandline.plans.dataset import target_spec

    assert models.Baseline("zero").fit(rows, ["f1"], target_spec("target_return_1d")).value == 0.0
    mean = models.Baseline("mean").fit(rows, ["f1"], target_spec("target_return_1d"))
    assert math.isclose(mean.value, rows.agg(F.avg("target_return_1d")).first()[0])
    share = models.Baseline("majority").fit(rows, ["f1"], target_spec("target_up_1d"))
    assert 0 < share.predict(rows).first()["p1"] < 1
    with pytest.raises(ValueError):
        models.Baseline("majority").fit(rows, ["f1"], target_spec("target_return_1d"))
    with pytest.raises(ValueError):
        models.Baseline("other")
    with pytest.raises(RuntimeError):
        models.Baseline().predict(rows)


def test_patience_decides_the_round():
    losses = [5.0, 4.0, 4.1, 4.2, 3.0, 3.5, 3.6]
    assert models.best_round(losses, 1) == (2, True) and models.best_round(losses, 2) == (2, True)
    assert models.best_round(losses, 3) == (5, False) and models.best_round([1.0, 2.0], 1) == (1, True)
    assert models.best_round([math.nan, math.nan], 5) == (1, False)


def test_trees_stop_by_their_patience(spark):
    """On noise the first rounds rarely gain in a row, so a longer patience finds a better round."""
    from strandline.plans.dataset import target_spec

    rng = np.random.default_rng(5)
    x, noise = rng.normal(size=(400, 2)), rng.normal(size=400)
    rows = [(float(a), float(b), float(a + 0.5 * a * b + n)) for (a, b), n in zip(x, noise, strict=True)]
    frame = spark.createDataFrame(rows, "f1 double, f2 double, target_return_1d double")
    fit, held = frame.limit(200), frame.subtract(frame.limit(200))
    fit, held = fit.persist(), held.persist()
    steps = {}
    for patience in (1, 30):
        model = models.BoostedTrees(n_estimators=40, max_depth=2, learning_rate=0.4, subsample=0.4, early_stopping_rounds=patience).fit(fit, ["f1", "f2"], target_spec("target_return_1d"), held)
        losses = model.model.evaluateEachIteration(model._vectors(held), "squared")
        steps[patience] = (model.best_step, losses[model.best_step - 1])
        wanted = model.predict(held)
        assert "_x" not in wanted.columns and not any(c.startswith("_t") for c in wanted.columns)
        got = wanted.agg(F.avg(F.pow(F.col("y_pred") - F.col("target_return_1d"), 2))).first()[0]
        assert math.isclose(got, losses[model.best_step - 1], rel_tol=1e-9)
    assert steps[1][0] != steps[30][0] and steps[30][1] < steps[1][1]
    with pytest.raises(ValueError):
        models.BoostedTrees(early_stopping_rounds=0)


def test_registry():
    assert models.available_models() == ("baseline_majority", "baseline_mean", "baseline_zero", "lstm", "transformer", "xgboost")
    with pytest.raises(ValueError, match="unknown model"):
        models.create_model("nothing")


@pytest.mark.parametrize("net", [networks.Lstm(4, 2), networks.Transformer(8, 2, 1, 8)])
@pytest.mark.parametrize("task", ["regression", "classification"])
def test_gradients_equal_differences(net, task):
    rng = np.random.default_rng(0)
    p, x, y = net.initial(3, rng), rng.normal(size=(5, 4, 3)), rng.integers(0, 2, 5).astype(float)
    values = {k: Value(v) for k, v in p.items()}
    z = net(values, x, None)
    z.backward(networks.loss_and_slope(z.data, y, task)[1])
    for k in p:
        i = tuple(rng.integers(n) for n in p[k].shape)
        shift = lambda d, k=k, i=i: networks.loss_and_slope(networks.infer(net, {**p, k: p[k] + d * (np.arange(p[k].size).reshape(p[k].shape) == np.ravel_multi_index(i, p[k].shape))}, x), y, task)[0]
        assert math.isclose((shift(1e-5) - shift(-1e-5)) / 2e-5, values[k].grad[i], rel_tol=1e-3, abs_tol=1e-7), k


@pytest.mark.parametrize("name", ["xgboost", "lstm", "transformer"])
@pytest.mark.parametrize("target", ["target_return_1d", "target_up_1d"])
def test_models_train_and_validate(spark, name, target):
    bundle, _ = experiment.chronological(built(spark, n=70), target_horizon=1)
    options = {"n_estimators": 3, "max_depth": 2} if name == "xgboost" else {"lookback": 3, "epochs": 2}
    result = experiment.train_and_validate(models.create_model(name, **options), bundle, target)
    assert all(v is None or math.isfinite(v) for v in result.metrics.values())
    assert result.predictions.count() == bundle.val.count()


def test_sequence_models_need_history(spark):
    bundle, _ = experiment.chronological(built(spark, n=70), target_horizon=1)
    model = models.lstm(lookback=3, epochs=1, hidden_dim=4)
    experiment.train_and_validate(model, bundle, "target_return_1d")
    with pytest.raises(ValueError, match="history"):
        model.predict(bundle.val)


def test_search_spaces_and_sampler():
    one = search.space("LSTM")
    one["parameters"].clear()
    assert search.space("LSTM")["parameters"] and search.space_identity("LSTM") == "lstm.v1"
    assert search.space_hash("XGBoost") == search.space_hash("XGBoost") != search.space_hash("LSTM")
    with pytest.raises(ValueError):
        search.space("other")
    goal = lambda t: (t.params["max_depth"] - 5) ** 2 + (math.log(t.params["learning_rate"]) + 3) ** 2
    a, b = (search.Study("s", search.space("XGBoost")["parameters"]).optimise(goal, 40) for _ in range(2))
    assert [t.params for t in a.trials] == [t.params for t in b.trials]
    guided = sorted(t.value for t in a.trials[10:])[:10]
    assert sum(guided) < sum(sorted(t.value for t in a.trials[:10]))
    assert all(2 <= t.params["max_depth"] <= 8 and 1e-3 <= t.params["learning_rate"] <= 0.3 for t in a.trials)
    assert search.summarise(a)["best_trial_number"] == a.best.number
    search.validate_study(a, 40)
    with pytest.raises(RuntimeError):
        search.validate_study(a, 30)
    a.trials[0].state = "PRUNED"
    with pytest.raises(RuntimeError):
        search.validate_study(a, 40)
    with pytest.raises(search.InvalidTrial):
        search.Study("s", search.space("LSTM")["parameters"]).optimise(lambda t: math.nan, 1)


def config(**given):
    base = dict(
        target="target_return_5d", task_type="regression", winning_model_family="XGBoost", best_hyperparameters={"max_depth": 3}, experiment_id="e", feature_schema=["f1"], inner_fold_geometry=[{"fold_id": 1}], purge_length=5,
        dataset_manifest="abc", search_space_identity="xgboost.v1", search_space_definition=search.space("XGBoost"), optuna_trial_metadata={"n": 30}, code_provenance={"commit": "x"},
    )
    return manifest.freeze_config(**base | given)


def test_frozen_manifest():
    manifest.validate_protocol_config(config())
    text, digest = manifest.frozen(config())
    assert json.loads(text)["target"] == "target_return_5d" and manifest.frozen(config())[1] == digest
    manifest.verify(config(), digest)
    with pytest.raises(ValueError):
        manifest.verify(config(purge_length=1), digest)
    for given in ({"objective": "rmse"}, {"optuna_trial_budget": 5}, {"winning_model_family": "Other"}, {"lookback": 5}, {"optuna_trial_metadata": {}}, {"aggregation_rules": "pooled"}, {"protocol_a_configuration": {"fit_fold": 1}}):
        with pytest.raises(ValueError):
            manifest.validate_protocol_config(config(**given))
    with pytest.raises(ValueError):
        manifest.frozen({k: v for k, v in config().items() if k != "target"})
    with pytest.raises(ValueError):
        manifest.frozen(config(inner_fold_geometry=[math.nan]))


def test_protocol_end_to_end(spark, tmp_path):
    panel = synthetic.pipeline_panel(spark, n_days=60)
    path = str(tmp_path / "manifest.json")
    small = {"XGBoost": {"n_estimators": 2}, "LSTM": {"epochs": 1}}
    result = run_protocol(panel, "target_return_1d", features=synthetic.FEATURES[:4], targets=synthetic.TARGETS, families=("XGBoost", "LSTM"), n_trials=1, n_startup=1, locked=False, manifest_path=path, overrides=small)
    with open(path) as f:
        assert json.load(f)["winning_model_family"] == result["winning_family"]
    assert math.isfinite(result["outer_validation_metrics"]["rmse"])
    with pytest.raises(ValueError, match="exactly 30"):
        run_protocol(panel, "target_return_1d", features=synthetic.FEATURES, targets=synthetic.TARGETS, n_trials=5)


def test_synthetic_panel_is_seeded(spark):
    a, b = (synthetic.pipeline_panel(spark, n_days=20, seed=7).orderBy("ticker", "session_date").collect() for _ in range(2))
    assert a == b and len(a) == 40 and all(r["session_date"].weekday() < 5 for r in a)
    assert a != synthetic.pipeline_panel(spark, n_days=20, seed=8).orderBy("ticker", "session_date").collect()
