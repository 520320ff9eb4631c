"""Sparse multinomial logistic regression, trained by follow-the-regularised-leader, with temperature calibration."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _weights(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """The leader in closed form: zero where the L1 penalty holds."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, width: int, *, epochs: int = 6, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, seed: int = 7) -> np.ndarray:
    """Weights (width + 1, classes), the last row for the bias, by FTRL-proximal with elastic-net penalties.

    ``rows`` are (indices, values); ``target`` has one distribution over classes a row.
    """
    classes = target.shape[1]
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))
    penalty = np.full((width + 1, 1), l1)
    penalty[-1] = 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, value = np.append(rows[i][0], width), np.append(rows[i][1], 1.0)
            zi, ni = z[index], n[index]
            w = _weights(zi, ni, alpha, beta, penalty[index], l2)
            g = value[:, None] * (softmax(value @ w) - target[i])
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
    return _weights(z, n, alpha, beta, penalty, l2)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda u: -np.log(np.maximum(softmax(logits / np.exp(u))[np.arange(len(y)), y], 1e-12)).mean()
    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
