"""Hashed sparse features and logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """FTRL-proximal logistic regression over 2**bits hashed features; index 0 is the bias."""

    def __init__(self, bits: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = weight * (sigmoid(float(w @ x)) - y) * x
        new = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = new

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels, epochs: int, seed: int = 5) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                self.learn(*rows[k], float(labels[k]))
        return self


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def summed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indices and how often each occurs."""
    return np.unique(at, return_counts=True)
