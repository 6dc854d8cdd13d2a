"""A small reverse-mode differentiator on NumPy, enough for the sequence networks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _fit(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum a gradient over the axes that broadcasting added or stretched."""
    while grad.ndim > len(shape):
        grad = grad.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and grad.shape[i] != 1:
            grad = grad.sum(axis=i, keepdims=True)
    return grad


class Value:
    """An array that remembers how it was made."""

    def __init__(self, data, parents: tuple[Value, ...] = (), back: Callable[[np.ndarray], tuple] | None = None):
        self.data = np.asarray(data, dtype=np.float64)
        self.parents, self.back = parents, back
        self.grad: np.ndarray | None = None

    def __add__(self, other):
        other = other if isinstance(other, Value) else Value(other)
        return Value(self.data + other.data, (self, other), lambda g: (_fit(g, self.data.shape), _fit(g, other.data.shape)))

    def __mul__(self, other):
        other = other if isinstance(other, Value) else Value(other)
        return Value(self.data * other.data, (self, other), lambda g: (_fit(g * other.data, self.data.shape), _fit(g * self.data, other.data.shape)))

    def __sub__(self, other):
        return self + (other if isinstance(other, Value) else Value(other)) * -1.0

    def __matmul__(self, other: Value):
        def back(g):
            a = g @ np.swapaxes(other.data, -1, -2)
            b = np.swapaxes(self.data, -1, -2) @ g
            return _fit(a, self.data.shape), _fit(b, other.data.shape)

        return Value(self.data @ other.data, (self, other), back)

    def apply(self, f: np.ndarray, slope: np.ndarray) -> Value:
        return Value(f, (self,), lambda g: (g * slope,))

    def tanh(self) -> Value:
        y = np.tanh(self.data)
        return self.apply(y, 1 - y * y)

    def sigmoid(self) -> Value:
        y = 0.5 * (1 + np.tanh(0.5 * self.data))
        return self.apply(y, y * (1 - y))

    def relu(self) -> Value:
        return self.apply(np.maximum(self.data, 0), (self.data > 0).astype(float))

    def power(self, p: float) -> Value:
        return self.apply(self.data**p, p * self.data ** (p - 1))

    def mean(self, axis=-1) -> Value:
        n = self.data.shape[axis]
        return Value(self.data.mean(axis=axis, keepdims=True), (self,), lambda g: (np.broadcast_to(g / n, self.data.shape),))

    def softmax(self) -> Value:
        e = np.exp(self.data - self.data.max(axis=-1, keepdims=True))
        y = e / e.sum(axis=-1, keepdims=True)
        return Value(y, (self,), lambda g: (y * (g - (g * y).sum(axis=-1, keepdims=True)),))

    def swap(self, a: int, b: int) -> Value:
        return Value(np.swapaxes(self.data, a, b), (self,), lambda g: (np.swapaxes(g, a, b),))

    def reshape(self, *shape: int) -> Value:
        return Value(self.data.reshape(shape), (self,), lambda g: (g.reshape(self.data.shape),))

    def part(self, key) -> Value:
        def back(g):
            out = np.zeros_like(self.data)
            out[key] = g
            return (out,)

        return Value(self.data[key], (self,), back)

    def dropout(self, rate: float, rng: np.random.Generator | None) -> Value:
        if rng is None or rate <= 0:
            return self
        return self * ((rng.random(self.data.shape) >= rate) / (1 - rate))

    def backward(self, grad: np.ndarray) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, ready = stack.pop()
            if ready:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack.extend((p, False) for p in node.parents)
        self.grad = grad
        for node in reversed(order):
            if node.back is not None and node.grad is not None:
                for p, g in zip(node.parents, node.back(node.grad), strict=True):
                    p.grad = g if p.grad is None else p.grad + g


def stack(values: list[Value], axis: int) -> Value:
    return Value(np.stack([v.data for v in values], axis=axis), tuple(values), lambda g: tuple(np.take(g, i, axis=axis) for i in range(len(values))))


def layer_norm(x: Value, gain: Value, bias: Value) -> Value:
    centred = x - x.mean()
    return centred * ((centred * centred).mean() + 1e-5).power(-0.5) * gain + bias
