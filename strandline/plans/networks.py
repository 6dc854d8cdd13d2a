"""Sequence networks: an LSTM and a Transformer encoder, read out at the last step."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from strandline.plans.autodiff import Value, layer_norm, stack

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Lstm:
    hidden_dim: int = 32
    num_layers: int = 1
    dropout: float = 0.0

    def initial(self, features: int, rng: np.random.Generator) -> Params:
        p, h = {}, self.hidden_dim
        draw = lambda *s: rng.uniform(-1, 1, s) / math.sqrt(h)
        for i in range(self.num_layers):
            p |= {f"w{i}": draw(features if i == 0 else h, 4 * h), f"u{i}": draw(h, 4 * h), f"b{i}": draw(4 * h)}
        return p | {"out": draw(h, 1), "bias": draw(1)}

    def __call__(self, p: dict[str, Value], x: np.ndarray, rng: np.random.Generator | None) -> Value:
        n, steps, _ = x.shape
        h = self.hidden_dim
        inputs = [Value(x[:, t]) for t in range(steps)]
        for i in range(self.num_layers):
            state, cell, outputs = Value(np.zeros((n, h))), Value(np.zeros((n, h))), []
            for v in inputs:
                gates = v @ p[f"w{i}"] + state @ p[f"u{i}"] + p[f"b{i}"]
                a, f, g, o = (gates.part((slice(None), slice(k * h, (k + 1) * h))) for k in range(4))
                cell = f.sigmoid() * cell + a.sigmoid() * g.tanh()
                state = o.sigmoid() * cell.tanh()
                outputs.append(state)
            inputs = [v.dropout(self.dropout, rng) for v in outputs] if i + 1 < self.num_layers else outputs
        return (inputs[-1] @ p["out"] + p["bias"]).reshape(n)


@dataclass(frozen=True)
class Transformer:
    d_model: int = 32
    nhead: int = 4
    num_layers: int = 1
    dim_feedforward: int = 64
    dropout: float = 0.0

    def initial(self, features: int, rng: np.random.Generator) -> Params:
        if self.d_model % self.nhead:
            raise ValueError("d_model is a multiple of nhead")
        d, f = self.d_model, self.dim_feedforward
        draw = lambda a, b: rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b))
        p = {"in": draw(features, d), "in_bias": np.zeros(d), "out": draw(d, 1), "bias": np.zeros(1)}
        for i in range(self.num_layers):
            p |= {f"q{i}": draw(d, d), f"k{i}": draw(d, d), f"v{i}": draw(d, d), f"o{i}": draw(d, d), f"f{i}": draw(d, f), f"fb{i}": np.zeros(f), f"g{i}": draw(f, d), f"gb{i}": np.zeros(d)}
            p |= {f"{n}{i}": np.ones(d) if n[0] == "s" else np.zeros(d) for n in ("s1_", "t1_", "s2_", "t2_")}
        return p

    def _positions(self, steps: int) -> np.ndarray:
        at, d = np.arange(steps)[:, None], self.d_model
        rate = np.exp(-math.log(10000.0) * np.arange(0, d, 2) / d)
        out = np.zeros((steps, d))
        out[:, 0::2], out[:, 1::2] = np.sin(at * rate), np.cos(at * rate)[:, : d // 2]
        return out

    def __call__(self, p: dict[str, Value], x: np.ndarray, rng: np.random.Generator | None) -> Value:
        n, steps, _ = x.shape
        d, heads = self.d_model, self.nhead
        z = (Value(x) @ p["in"] + p["in_bias"] + self._positions(steps)).dropout(self.dropout, rng)
        split = lambda v: v.reshape(n, steps, heads, d // heads).swap(1, 2)
        for i in range(self.num_layers):
            q, k, v = (split(z @ p[f"{m}{i}"]) for m in "qkv")
            weights = ((q @ k.swap(2, 3)) * (1 / math.sqrt(d // heads))).softmax().dropout(self.dropout, rng)
            mixed = (weights @ v).swap(1, 2).reshape(n, steps, d) @ p[f"o{i}"]
            z = layer_norm(z + mixed.dropout(self.dropout, rng), p[f"s1_{i}"], p[f"t1_{i}"])
            wide = (z @ p[f"f{i}"] + p[f"fb{i}"]).relu().dropout(self.dropout, rng)
            z = layer_norm(z + (wide @ p[f"g{i}"] + p[f"gb{i}"]).dropout(self.dropout, rng), p[f"s2_{i}"], p[f"t2_{i}"])
        return (z.part((slice(None), -1)) @ p["out"] + p["bias"]).reshape(n)


def loss_and_slope(z: np.ndarray, y: np.ndarray, task: str) -> tuple[float, np.ndarray]:
    """Mean loss and its slope by output: squared error, or cross entropy of logits."""
    if task == "regression":
        return float(np.mean((z - y) ** 2)), 2 * (z - y) / len(y)
    loss = np.logaddexp(0, z) - z * y
    return float(np.mean(loss)), (0.5 * (1 + np.tanh(0.5 * z)) - y) / len(y)


@dataclass
class Adam:
    lr: float
    step: int = 0

    def __post_init__(self):
        self.m: Params = {}
        self.v: Params = {}

    def update(self, p: Params, grads: Params) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.step), self.v[k] / (1 - 0.999**self.step)
            p[k] = p[k] - self.lr * m / (np.sqrt(v) + 1e-8)


def train_pass(net, p: Params, x: np.ndarray, y: np.ndarray, task: str, optimiser: Adam, batch: int, rng: np.random.Generator) -> None:
    """One pass over rows in their order, in mini-batches; ``p`` changes in place."""
    for i in range(0, len(y), batch):
        values = {k: Value(v) for k, v in p.items()}
        z = net(values, x[i : i + batch], rng)
        _, slope = loss_and_slope(z.data, y[i : i + batch], task)
        z.backward(slope)
        optimiser.update(p, {k: v.grad for k, v in values.items() if v.grad is not None})


def infer(net, p: Params, x: np.ndarray) -> np.ndarray:
    return net({k: Value(v) for k, v in p.items()}, x, None).data


__all__ = ["Adam", "Lstm", "Transformer", "infer", "loss_and_slope", "stack", "train_pass"]
