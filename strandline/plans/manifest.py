"""Manifests: canonical JSON and hashes of splits and of frozen experiment configurations."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
from collections.abc import Iterable
from copy import deepcopy
from dataclasses import asdict, dataclass
from importlib.metadata import PackageNotFoundError, version
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.search import canonical

# The contract's fields and locked settings.
REQUIRED = (
    *("experiment_id", "version", "target", "task_type", "winning_model_family", "lookback", "best_hyperparameters", "model_architecture"),
    *("feature_schema", "preprocessing_configuration", "inner_fold_geometry", "purge_length", "scoring_row_rule"),
    *("sequence_scoring_alignment_rule", "early_stopping_configuration", "protocol_a_configuration", "random_seed", "device"),
    *("determinism_settings", "objective", "secondary_metrics", "aggregation_rules", "baseline_definition", "optuna_trial_budget"),
    *("optuna_sampler_configuration", "search_space_definition", "dataset_manifest", "code_provenance", "library_versions"),
)
REQUIRED_BY_PROTOCOL = ("search_space_identity", "optuna_trial_metadata")
OBJECTIVES = {"regression": "relative_rmse", "classification": "logloss"}
SECONDARY = {"regression": ["rmse", "mae", "r2", "directional_accuracy", "pearson_ic"], "classification": ["accuracy", "precision", "recall", "f1"]}
BASELINES = {"regression": "zero_return_baseline", "classification": "majority_class_baseline"}
AGGREGATION = "mean_across_tickers_then_mean_across_folds"
SCORING_RULE = "shared_max_lookback_10"
ALIGNMENT_RULE = "exact_matching_ticker_and_session_date"
PROTOCOL = {"fit_fold": 2, "selection_fold": 2, "refit_fresh_model": True, "outer_retraining": False, "early_stopping_source": "fold_2_inner_selection"}
EARLY_STOPPING = {
    "XGBoost": {"early_stopping_rounds": 30, "n_estimators": 1000, "selection_rule": "best_validation_iteration"},
    "LSTM": {"epochs": 15, "selection_rule": "best_validation_epoch"},
    "Transformer": {"epochs": 15, "selection_rule": "best_validation_epoch"},
}
SAMPLER = {"sampler": "TPESampler", "n_startup_trials": 10, "n_jobs": 1, "pruner": "NopPruner"}
BUDGET = 30
#: What a configuration has unless it says otherwise.
DEFAULTS = {
    "aggregation_rules": AGGREGATION,
    "device": "cpu",
    "optuna_trial_budget": BUDGET,
    "optuna_trial_metadata": {},
    "preprocessing_configuration": {"scaler_type": "standard", "fit_scope": "inner_fit_only"},
    "protocol_a_configuration": PROTOCOL,
    "scoring_row_rule": SCORING_RULE,
    "search_space_definition": {},
    "search_space_identity": None,
    "sequence_scoring_alignment_rule": ALIGNMENT_RULE,
    "version": "1.0.0",
}
#: What follows from the task.
BY_TASK = {"baseline_definition": BASELINES, "objective": OBJECTIVES, "secondary_metrics": SECONDARY}


def library_versions(names: Iterable[str] = ("pyspark", "numpy", "pyarrow", "pandas")) -> dict[str, str]:
    found = {"python": platform.python_version()}
    for name in names:
        try:
            found[name] = version(name)
        except PackageNotFoundError:
            found[name] = "absent"
    return found


def code_provenance() -> dict[str, Any]:
    """The commit, branch and state of the working tree, where there is one."""

    def ask(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    status = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "dirty": None if status is None else bool(status)}


def freeze_config(*, target: str, task_type: str, winning_model_family: str, best_hyperparameters: dict[str, Any], random_seed: int = 42, **given: Any) -> dict[str, Any]:
    """A configuration with the protocol's defaults; every field can be given."""
    own = {"target": target, "task_type": task_type, "winning_model_family": winning_model_family, "random_seed": random_seed, "best_hyperparameters": dict(best_hyperparameters)}
    seeded = {"optuna_sampler_configuration": {**SAMPLER, "seed": random_seed}, "determinism_settings": {"numpy_seed": random_seed, "ordered_passes": True}}
    of_family = {"model_architecture": {"family": winning_model_family}, "early_stopping_configuration": EARLY_STOPPING.get(winning_model_family, EARLY_STOPPING["LSTM"]), "lookback": best_hyperparameters.get("lookback")}
    told = {"code_provenance": code_provenance(), "library_versions": library_versions()}
    config = deepcopy(DEFAULTS) | {field: table.get(task_type) for field, table in BY_TASK.items()} | of_family | seeded | told | own
    return config | {k: v for k, v in given.items() if v is not None}


def validate_config(config: dict[str, Any]) -> None:
    """All fields are there; only the lookback may be null."""
    if missing := [f for f in REQUIRED if f not in config]:
        raise ValueError(f"missing fields: {missing}")
    if empty := [f for f in REQUIRED if f != "lookback" and config[f] is None]:
        raise ValueError(f"null fields: {empty}")


def validate_protocol_config(config: dict[str, Any]) -> None:
    """The configuration keeps to the locked protocol."""
    validate_config(config)
    if missing := [f for f in REQUIRED_BY_PROTOCOL if f not in config]:
        raise ValueError(f"missing fields: {missing}")
    family, task = config["winning_model_family"], config["task_type"]
    if family not in EARLY_STOPPING:
        raise ValueError(f"unknown model family {family!r}")
    if task not in OBJECTIVES:
        raise ValueError(f"unknown task {task!r}")
    locked = {"objective": OBJECTIVES[task], "aggregation_rules": AGGREGATION, "scoring_row_rule": SCORING_RULE, "sequence_scoring_alignment_rule": ALIGNMENT_RULE, "optuna_trial_budget": BUDGET}
    nested = {"optuna_sampler_configuration": {**SAMPLER, "seed": config["random_seed"]}, "protocol_a_configuration": PROTOCOL, "early_stopping_configuration": EARLY_STOPPING[family]}
    for name, wanted in locked.items():
        if config[name] != wanted:
            raise ValueError(f"{name} is locked to {wanted!r}, not {config[name]!r}")
    for name, wanted in nested.items():
        for key, value in wanted.items():
            given = config[name].get(key)
            if given != value and not (key == "pruner" and given is None):
                raise ValueError(f"{name}.{key} is locked to {value!r}, not {given!r}")
    for name in ("search_space_identity", "search_space_definition", "optuna_trial_metadata", "code_provenance"):
        if not config[name]:
            raise ValueError(f"{name} is empty")
    for name in ("search_space_definition", "optuna_trial_metadata", "code_provenance"):
        if not isinstance(config[name], dict):
            raise ValueError(f"{name} is no mapping")
    if family == "XGBoost" and config["lookback"] is not None:
        raise ValueError("trees have no lookback")
    if family != "XGBoost" and config["lookback"] not in (5, 10):
        raise ValueError("the lookback is 5 or 10")


def frozen(config: dict[str, Any]) -> tuple[str, str]:
    """Canonical JSON of a valid configuration and its SHA-256."""
    validate_config(config)
    text = canonical(config)
    return text, hashlib.sha256(text.encode()).hexdigest()


def verify(config: dict[str, Any], expected: str) -> None:
    if (found := frozen(config)[1]) != expected:
        raise ValueError(f"manifest hash mismatch: expected {expected}, found {found}")


def write_manifest(config: dict[str, Any], path: str) -> str:
    text, digest = frozen(config)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return digest


@dataclass(frozen=True)
class SplitManifest:
    fold_id: int
    split_config: dict[str, Any]
    train_date_bounds: tuple[str, str]
    val_date_bounds: tuple[str, str]
    test_date_bounds: tuple[str, str] | None
    n_train_raw: int
    n_train_purged: int
    n_train_final: int
    n_val_raw: int
    n_val_purged: int
    n_val_final: int
    n_test: int
    train_index_hash: str
    val_index_hash: str
    manifest_hash: str

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, sort_keys=True)


def index_hash(ids: Iterable[int]) -> str:
    """SHA-256 over the sorted ids as 64-bit integers."""
    return hashlib.sha256(np.sort(np.fromiter(ids, dtype=np.int64)).tobytes()).hexdigest()


def table_hash(rows: DataFrame, keys: list[str], id_col: str = "row_id") -> DataFrame:
    """An order-free digest of the ids by ``keys`` that never brings them together:
    counts, and sums of the two halves of each id's SHA-256."""
    digest = F.sha2(F.col(id_col).cast("string"), 256)
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(half(1)).alias("_a"), F.sum(half(16)).alias("_b"))
    return sums.select(*keys, F.sha2(F.concat_ws(":", "_n", "_a", "_b"), 256).alias("index_hash"))


def split_manifests(roles: DataFrame, split_config: dict[str, Any], *, id_col: str = "row_id") -> list[SplitManifest]:
    """One manifest a fold, from one aggregate over the role table.  Raw counts are not hashed."""
    from strandline.operators.splits import split_counts

    counts = {(r["fold_id"], r["role"]): r for r in split_counts(roles).collect()}  # folds times roles
    hashes = {(r["fold_id"], r["role"]): r["index_hash"] for r in table_hash(roles.where("status = 'kept'"), ["fold_id", "role"], id_col).collect()}
    out = []
    for fold in sorted({f for f, _ in counts}):
        train, val, test = (counts.get((fold, role)) for role in ("train", "val", "test"))
        bounds = lambda r: (str(r["first_date"]), str(r["last_date"])) if r else None
        body = {
            "fold_id": fold,
            "split_config": split_config | {"train_embargoed_count": train["n_embargoed"], "train_horizon_purged_count": train["n_purged"]},
            "train_date_bounds": bounds(train),
            "val_date_bounds": bounds(val),
            "test_date_bounds": bounds(test),
            "n_train_final": train["n_kept"],
            "n_train_purged": train["n_raw"] - train["n_kept"],
            "n_val_final": val["n_kept"],
            "n_val_purged": val["n_raw"] - val["n_kept"],
            "n_test": test["n_kept"] if test else 0,
            "train_index_hash": hashes.get((fold, "train"), index_hash([])),
            "val_index_hash": hashes.get((fold, "val"), index_hash([])),
        }
        digest = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        out.append(SplitManifest(n_train_raw=train["n_raw"], n_val_raw=val["n_raw"], manifest_hash=digest, **body))
    return out
