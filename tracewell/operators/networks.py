"""Dense layers and the optimiser that the learned scorers and re-rankers share, in numpy."""

from __future__ import annotations

import numpy as np


def dense(rng: np.random.Generator, *sizes: int) -> list[np.ndarray]:
    """Weights and biases of layers of these sizes, uniform within 1 / sqrt(inputs)."""
    out = []
    for a, b in zip(sizes, sizes[1:]):
        out += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return out


def forward(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Input of each layer, and the output last; ReLU between layers."""
    at = [x]
    for k in range(0, len(layers), 2):
        x = at[-1] @ layers[k] + layers[k + 1]
        at.append(np.maximum(x, 0) if k + 2 < len(layers) else x)
    return at


def backward(layers: list[np.ndarray], at: list[np.ndarray], g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradients of the input and of the layers, from that of the output."""
    grads: list[np.ndarray] = []
    for k in range(len(layers) - 2, -1, -2):
        x = at[k // 2]
        grads = [x.T @ g, g.sum(axis=0), *grads]
        g = g @ layers[k].T
        if k:
            g = g * (x > 0)
    return g, grads


class Adam:
    """Steps of Adam on a list of arrays, in place."""

    def __init__(self, values: list[np.ndarray], rate: float, decay: float = 0.0):
        self.values, self.rate, self.decay, self.k = values, rate, decay, 0
        self.m, self.v = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]

    def step(self, grads: list[np.ndarray]) -> None:
        self.k += 1
        for p, g, m, v in zip(self.values, grads, self.m, self.v, strict=True):
            g = g + self.decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.k)) / (np.sqrt(v / (1 - 0.999**self.k)) + 1e-8)
