"""Models over datasets: baselines, boosted trees, sequence networks, and their registry.

A model's ``fit`` takes training rows and, if it selects an iteration, selection
rows; ``predict`` adds y_pred (regression) or p1 (classification) to rows.
Rows stay distributed: trees train in ``pyspark.ml``; networks train by passes
in which each partition starts from the shared parameters and their averages,
weighted by rows, become the next ones.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.metrics import classification_metrics, finite, regression_metrics
from strandline.plans.dataset import TargetSpec, check_target, lookback_sequences
from strandline.plans.networks import Adam, Lstm, Transformer, infer, loss_and_slope, train_pass


class Model:
    """The contract of all models."""

    name = "model"
    #: Whether an inner holdout is needed to choose an iteration.
    selects = False
    #: Rows of history a prediction needs, its own included; 0 for none.
    lookback = 0

    def __init__(self):
        self.spec: TargetSpec | None = None
        self.features: tuple[str, ...] = ()
        self.best_step: int | None = None

    def begin(self, rows: DataFrame, features: Sequence[str], spec: TargetSpec) -> None:
        if self.spec is not None and self.spec != spec:
            raise ValueError(f"the model is for {self.spec.name}, not {spec.name}")
        check_target(rows, spec)
        self.spec, self.features = spec, tuple(features)

    def fit(self, rows: DataFrame, features: Sequence[str], spec: TargetSpec, selection: DataFrame | None = None, history: DataFrame | None = None) -> Model:
        raise NotImplementedError

    def predict(self, rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def fitted(self) -> TargetSpec:
        if self.spec is None:
            raise RuntimeError("the model is not fitted")
        return self.spec

    def params(self) -> dict[str, Any]:
        return {}

    def evaluate(self, rows: DataFrame, history: DataFrame | None = None) -> dict[str, float]:
        spec = self.fitted()
        return score(self.predict(rows, history), spec)


def score(predicted: DataFrame, spec: TargetSpec, keys: Sequence[str] = ()) -> Any:
    """Metrics of predictions by the target's task: a dict, or a DataFrame by ``keys``."""
    if spec.task == "regression":
        out = regression_metrics(predicted, keys, y=spec.name)
    else:
        out = classification_metrics(predicted, keys, y=spec.name)
    return out if keys else {k: v for k, v in out.first().asDict().items() if k != "n"}


class Baseline(Model):
    """Predicts zero, the training mean, or the training share of ups."""

    def __init__(self, strategy: str = "zero"):
        super().__init__()
        if strategy not in ("zero", "mean", "majority"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.strategy, self.value, self.name = strategy, 0.0, f"baseline_{strategy}"

    def fit(self, rows, features, spec, selection=None, history=None):
        if (self.strategy == "majority") != (spec.task == "classification"):
            raise ValueError(f"the {self.strategy} baseline is not for {spec.task}")
        self.begin(rows, features, spec)
        y = F.when(finite(F.col(spec.name)), F.col(spec.name))
        n, mean, ups = rows.agg(F.count(y), F.avg(y), F.avg((y > 0).cast("double"))).first()
        if not n:
            raise ValueError("no finite target values")
        self.value = {"zero": 0.0, "mean": mean, "majority": ups}[self.strategy]
        return self

    def predict(self, rows, history=None):
        spec = self.fitted()
        if spec.task == "regression":
            return rows.withColumn("y_pred", F.lit(float(self.value)))
        return rows.withColumns({"p1": F.lit(float(self.value)), "y_pred": F.lit(1.0 if self.value >= 0.5 else 0.0)})

    def params(self):
        return {"strategy": self.strategy, "value": self.value}


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """The number of rounds up to the best loss seen before ``patience`` rounds brought no gain,
    and whether that many did."""
    best, at = math.inf, 0
    for i, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            return max(at, 1), True
    return max(at, 1), False


class BoostedTrees(Model):
    """Gradient-boosted trees, cut at the best round on the selection rows once
    ``early_stopping_rounds`` rounds have brought no gain there."""

    name, selects = "boosted_trees", True

    def __init__(self, n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.05, subsample: float = 0.8, colsample_bytree: float = 0.8, random_state: int = 42, early_stopping_rounds: int = 10):
        super().__init__()
        if early_stopping_rounds < 1:
            raise ValueError("early_stopping_rounds is at least 1")
        self.options = dict(n_estimators=n_estimators, max_depth=max_depth, learning_rate=learning_rate, subsample=subsample, colsample_bytree=colsample_bytree, random_state=random_state, early_stopping_rounds=early_stopping_rounds)
        self.model = None

    def _vectors(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return rows.withColumn("_x", array_to_vector(F.array(*(F.col(f).cast("double") for f in self.features))))

    def fit(self, rows, features, spec, selection=None, history=None):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.regression import GBTRegressor

        if selection is None:
            raise ValueError("selection rows are needed for early stopping")
        self.begin(rows, features, spec)
        o = self.options
        kind = GBTRegressor if spec.task == "regression" else GBTClassifier
        trees = kind(
            featuresCol="_x", labelCol=spec.name, maxDepth=o["max_depth"], stepSize=o["learning_rate"], subsamplingRate=o["subsample"],
            featureSubsetStrategy=str(o["colsample_bytree"]) if o["colsample_bytree"] < 1 else "all", seed=o["random_state"],
        )
        columns = [*self.features, spec.name]
        fit, held = self._vectors(rows.select(*columns)), self._vectors(selection.select(*columns))
        # A round's tree does not depend on the rounds after it: fewer are tried first.
        rounds = min(o["n_estimators"], 4 * o["early_stopping_rounds"])
        while True:
            self.model = trees.setMaxIter(rounds).fit(fit)
            losses = self.model.evaluateEachIteration(held, "squared") if spec.task == "regression" else self.model.evaluateEachIteration(held)
            self.best_step, stopped = best_round(losses, o["early_stopping_rounds"])
            if stopped or rounds == o["n_estimators"]:
                return self
            rounds = min(o["n_estimators"], 3 * rounds)

    def predict(self, rows, history=None):
        spec = self.fitted()
        out, margin = self._vectors(rows), F.lit(0.0)
        for i, (tree, weight) in enumerate(zip(self.model.trees[: self.best_step], self.model.treeWeights, strict=False)):
            out = tree.setPredictionCol(f"_t{i}").transform(out)
            margin = margin + F.lit(float(weight)) * F.col(f"_t{i}")
        helpers = ["_x", *(f"_t{i}" for i in range(self.best_step))]
        if spec.task == "regression":
            return out.withColumn("y_pred", margin).drop(*helpers)
        # The trees fit half the log odds.
        out = out.withColumn("p1", 1 / (1 + F.exp(-2 * margin)))
        return out.withColumn("y_pred", F.when(F.col("p1") > 0.5, 1.0).otherwise(0.0)).drop(*helpers)

    def params(self):
        return dict(self.options)


def _arrays(batch: pa.RecordBatch, steps: int, features: int) -> np.ndarray:
    flat = batch.column("sequence").flatten().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, steps, features)


class SequenceModel(Model):
    """A network over the last ``lookback`` rows of a ticker, with the best selection pass restored."""

    selects = True

    def __init__(self, net, name: str, *, lookback: int = 10, max_lookback: int | None = None, lr: float = 0.005, epochs: int = 15, batch_size: int = 32, seed: int = 42):
        super().__init__()
        self.net, self.name, self.lookback = net, name, lookback
        self.max_lookback = max_lookback or lookback
        self.lr, self.epochs, self.batch_size, self.seed = lr, epochs, batch_size, seed
        self.weights: dict[str, np.ndarray] | None = None

    def _sequences(self, rows: DataFrame, history: DataFrame | None) -> DataFrame:
        """Sequences that end in ``rows``; ``history`` gives earlier rows only."""
        columns = ["ticker", "session_date", *self.features]
        tagged = rows.withColumn("_own", F.lit(True))
        if history is not None:
            before = history.select(*columns).join(rows.select("ticker", "session_date"), ["ticker", "session_date"], "left_anti")
            tagged = tagged.unionByName(before.withColumn("_own", F.lit(False)), allowMissingColumns=True)
        return lookback_sequences(tagged, self.features, lookback=self.lookback, max_lookback=self.max_lookback).where("_own").drop("_own")

    def fit(self, rows, features, spec, selection=None, history=None):
        if selection is None:
            raise ValueError("selection rows are needed to choose a pass")
        self.begin(rows, features, spec)
        order = ["session_date", "ticker"]
        train = self._sequences(rows, None).select("sequence", F.col(spec.name).alias("y"), *order).sortWithinPartitions(*order).persist()
        held = self._sequences(selection, history if history is not None else rows).select("sequence", F.col(spec.name).alias("y")).persist()
        try:
            if not train.take(1) or not held.take(1):
                raise ValueError(f"no rows with {self.max_lookback} rows of history")
            rng = np.random.default_rng(self.seed)
            weights = self.net.initial(len(self.features), rng)
            best, best_loss = None, math.inf
            for epoch in range(self.epochs):
                weights = self._pass(train, weights, epoch)
                loss = self._loss(held, weights)
                if not math.isfinite(loss):
                    raise ValueError("non-finite selection loss")
                if loss < best_loss:
                    best, best_loss, self.best_step = weights, loss, epoch + 1
            self.weights = best
        finally:
            train.unpersist()
            held.unpersist()
        return self

    def _pass(self, train: DataFrame, weights: dict[str, np.ndarray], epoch: int) -> dict[str, np.ndarray]:
        shared = train.sparkSession.sparkContext.broadcast(pickle.dumps(weights))  # the model's own size
        net, task, lr, size, seed, steps, width = self.net, self.spec.task, self.lr, self.batch_size, self.seed, self.lookback, len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            p, n, optimiser, rng = pickle.loads(shared.value), 0, Adam(lr), np.random.default_rng([seed, epoch, part])
            for batch in batches:
                y = batch.column("y").to_numpy()
                train_pass(net, p, _arrays(batch, steps, width), y, task, optimiser, size, rng)
                n += len(y)
            if n:
                yield pa.RecordBatch.from_pydict({"slot": pa.array([part % 16], pa.int32()), "n": pa.array([n], pa.int64()), "weights": pa.array([pickle.dumps({k: v * n for k, v in p.items()})], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            total: dict[str, np.ndarray] = {}
            for raw in table.column("weights"):
                for k, v in pickle.loads(raw.as_py()).items():
                    total[k] = total.get(k, 0.0) + v
            n = sum(table.column("n").to_pylist())
            return pa.table({"n": pa.array([n], pa.int64()), "weights": pa.array([pickle.dumps(total)], pa.binary())})

        sums = train.select("sequence", "y").mapInArrow(run, "slot int, n long, weights binary").groupBy("slot").applyInArrow(add, "n long, weights binary").collect()  # 16 rows at most
        n = sum(r["n"] for r in sums)
        parts = [pickle.loads(r["weights"]) for r in sums]
        return {k: sum(p[k] for p in parts) / n for k in parts[0]}

    def _loss(self, held: DataFrame, weights: dict[str, np.ndarray]) -> float:
        net, task, steps, width = self.net, self.spec.task, self.lookback, len(self.features)
        raw = pickle.dumps(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = pickle.loads(raw)
            for batch in batches:
                y = batch.column("y").to_numpy()
                loss, _ = loss_and_slope(infer(net, p, _arrays(batch, steps, width)), y, task)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(y)], pa.int64()), "loss": pa.array([loss * len(y)], pa.float64())})

        n, loss = held.mapInArrow(run, "n long, loss double").agg(F.sum("n"), F.sum("loss")).first()
        return loss / n

    def predict(self, rows, history=None):
        spec = self.fitted()
        sequences = self._sequences(rows, history)
        if rows.join(sequences.select("ticker", "session_date"), ["ticker", "session_date"], "left_anti").take(1):
            raise ValueError(f"a row has fewer than {self.max_lookback} rows of history")
        net, raw, steps, width, task = self.net, pickle.dumps(self.weights), self.lookback, len(self.features), spec.task
        names = list(rows.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = pickle.loads(raw)
            for batch in batches:
                z = infer(net, p, _arrays(batch, steps, width)) if batch.num_rows else np.empty(0)
                extra = {"y_pred": z} if task == "regression" else {"p1": 1 / (1 + np.exp(-z)), "y_pred": (z >= 0).astype(float)}
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(v, pa.float64()) for v in extra.values())], names=[*names, *extra])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return sequences.select(*names, "sequence").mapInArrow(run, f"{fields}, " + ("y_pred double" if task == "regression" else "p1 double, y_pred double"))

    def params(self):
        return {"lookback": self.lookback, "max_lookback": self.max_lookback, "lr": self.lr, "epochs": self.epochs, "batch_size": self.batch_size, "seed": self.seed, **vars(self.net)}


def lstm(*, hidden_dim: int = 32, num_layers: int = 1, dropout: float = 0.0, **options) -> SequenceModel:
    return SequenceModel(Lstm(hidden_dim, num_layers, dropout), "lstm", **options)


def transformer(*, d_model: int = 32, nhead: int = 4, num_layers: int = 1, dim_feedforward: int = 64, dropout: float = 0.0, **options) -> SequenceModel:
    return SequenceModel(Transformer(d_model, nhead, num_layers, dim_feedforward, dropout), "transformer", **options)


REGISTRY: dict[str, Callable[..., Model]] = {
    "baseline_zero": lambda **k: Baseline("zero", **k),
    "baseline_mean": lambda **k: Baseline("mean", **k),
    "baseline_majority": lambda **k: Baseline("majority", **k),
    "xgboost": BoostedTrees,
    "lstm": lstm,
    "transformer": transformer,
}


def available_models() -> tuple[str, ...]:
    return tuple(sorted(REGISTRY))


def create_model(name: str, **options) -> Model:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(available_models())}")
    return REGISTRY[name](**options)
