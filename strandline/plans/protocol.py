"""The search protocol: tune on inner folds, freeze a manifest, open the gate, evaluate once."""

from __future__ import annotations

import os
import random
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.metrics import finite, macro_objective
from strandline.plans import manifest, search
from strandline.plans.dataset import ModelDataset, TargetSpec, build_dataset, target_spec
from strandline.plans.experiment import FoldBundle, InnerFold, ValidationGate, chronological, inner_folds, release
from strandline.plans.models import Model, create_model, score

FAMILIES = {"XGBoost": "xgboost", "LSTM": "lstm", "Transformer": "transformer"}


def set_seed(seed: int) -> None:
    """Seeds of the driver; columns and models take theirs explicitly."""
    random.seed(seed)
    np.random.seed(seed)
    os.environ["PYTHONHASHSEED"] = str(seed)


def evaluate_on_folds(model_of, folds: Sequence[InnerFold], spec: TargetSpec, trial: search.Trial | None = None) -> float:
    """Mean over folds of the mean over tickers of the objective, on selection rows."""
    scores, steps, by_ticker = [], [], []
    for fold in folds:
        model: Model = model_of()
        try:
            model.fit(fold.fit, fold.features, spec, fold.selection, fold.context)
        except ValueError as error:
            if "non-finite" in str(error).lower():
                raise search.InvalidTrial(str(error)) from error
            raise
        predicted = model.predict(fold.selection, fold.context)
        value = "y_pred" if spec.task == "regression" else "p1"
        if predicted.where(~finite(F.col(value))).take(1):
            raise search.InvalidTrial("a prediction is not finite")
        rows = predicted.withColumns({"y_true": F.col(spec.name), "fold_id": F.lit(fold.fold_id)}).persist()
        try:
            result = macro_objective(rows, spec.task).first()["objective"]
            by_ticker.append({r["ticker"]: {k: v for k, v in r.asDict().items() if k != "ticker"} for r in score(rows, spec, ["ticker"]).toLocalIterator()})
        finally:
            rows.unpersist()
        if result is None:
            raise search.InvalidTrial("no predictions to score")
        scores.append(result)
        steps.append(model.best_step)
    from strandline.functions.metrics import finite_mean

    overall = finite_mean(scores, label="fold scores")
    if trial is not None:
        trial.user_attrs |= {"target": spec.name, "task_type": spec.task, "fold_scores": scores, "fold_ticker_metrics": by_ticker, "fold_best_iteration_or_epoch": steps, "objective_score": overall}
    return overall


def objective(family: str, folds: Sequence[InnerFold], spec: TargetSpec, overrides: dict[str, Any] | None = None):
    """A function of a trial: sampled and fixed parameters of the family's space."""
    fixed = search.space(family)["fixed_parameters"] | (overrides or {})

    def run(trial: search.Trial) -> float:
        trial.user_attrs |= {"model_family": family, "lookback": trial.params.get("lookback"), "max_lookback": fixed.get("max_lookback")}
        return evaluate_on_folds(lambda: create_model(FAMILIES[family], **trial.params, **fixed), folds, spec, trial)

    return run


def run_protocol(
    panel: DataFrame,
    target: str,
    *,
    features: Sequence[str],
    targets: Sequence[str],
    families: Sequence[str] = tuple(FAMILIES),
    n_trials: int = manifest.BUDGET,
    n_startup: int = 10,
    seed: int = 42,
    locked: bool = True,
    manifest_path: str | None = None,
    overrides: dict[str, dict[str, Any]] | None = None,
) -> dict[str, Any]:
    """The whole protocol on a panel.

    ``locked`` enforces the budget of the protocol; without it smaller searches
    can be run, whose manifest is checked for completeness only.  Validation rows
    stay behind the gate until the manifest is written.
    """
    spec = target_spec(target)
    if locked and (n_trials, n_startup) != (manifest.BUDGET, 10):
        raise ValueError(f"the protocol has exactly {manifest.BUDGET} trials, 10 of them at random")
    set_seed(seed)
    dataset: ModelDataset = build_dataset(panel, feature_columns=features, target_columns=targets)
    dataset = dataset.with_rows(dataset.rows.persist())
    held: list[FoldBundle | InnerFold] = []
    try:
        bundle, _quarantined = chronological(dataset, target_horizon=spec.horizon)
        held.append(bundle)
        held += (folds := inner_folds(bundle, target_horizon=spec.horizon))
        return _searched(spec, dataset, bundle, folds, families, n_trials, n_startup, seed, locked, manifest_path, overrides or {})
    finally:
        release(*held)
        dataset.rows.unpersist()


def _searched(spec, dataset, bundle, folds, families, n_trials, n_startup, seed, locked, manifest_path, extra) -> dict[str, Any]:
    """Search on the inner folds, freeze, open the gate, evaluate once."""
    target, gate = spec.name, ValidationGate(bundle)
    studies = {}
    for family in families:
        study = search.Study(f"{family}_study", search.space(family)["parameters"], seed=seed, startup=n_startup)
        studies[family] = study.optimise(objective(family, folds, spec, extra.get(family)), n_trials)
        search.validate_study(study, n_trials)
    winner = min(families, key=lambda f: studies[f].best.value)  # the first of equals
    best = studies[winner].best
    config = manifest.freeze_config(
        experiment_id=f"protocol_{target}_{winner}",
        target=target,
        task_type=spec.task,
        winning_model_family=winner,
        best_hyperparameters=best.params,
        random_seed=seed,
        feature_schema=list(dataset.features),
        inner_fold_geometry=[f.geometry for f in folds],
        purge_length=spec.horizon,
        dataset_manifest=bundle.manifest.manifest_hash,
        model_architecture={"family": winner, "locked_parameters": dict(best.params)},
        optuna_trial_budget=n_trials,
        optuna_sampler_configuration={**manifest.SAMPLER, "seed": seed, "n_startup_trials": n_startup},
        search_space_identity=search.space_identity(winner),
        search_space_definition=search.space(winner),
        optuna_trial_metadata={"winning_model_family": winner, "winning_search_space_hash": search.space_hash(winner), "studies": {f: search.summarise(s) for f, s in studies.items()}},
    )
    if locked:
        manifest.validate_protocol_config(config)
    digest = manifest.write_manifest(config, manifest_path) if manifest_path else manifest.frozen(config)[1]

    opened = gate.freeze().open().bundle()
    final = folds[-1]
    model = create_model(FAMILIES[winner], **best.params, **(search.space(winner)["fixed_parameters"] | extra.get(winner, {})))
    model.fit(final.fit, final.features, spec, final.selection, final.context)
    # The second fold's scaler, and the unpurged training rows as history.
    val, history = (final.scaler.transform(rows, final.features) for rows in (opened.val_raw, opened.context_raw))
    predicted = model.predict(val, history)
    return {
        "target": target,
        "task_type": spec.task,
        "target_horizon": spec.horizon,
        "winning_family": winner,
        "best_hyperparameters": best.params,
        "best_step": model.best_step,
        "manifest_hash": digest,
        "outer_validation_metrics": score(predicted, spec),
    }
