"""Follow-the-regularised-leader with an elastic net, for dense batches of sparse problems."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of FTRL-proximal: per coordinate learning rates, l1 keeps weights at zero until they matter, l2 shrinks them."""

    def __init__(self, shape: tuple[int, ...], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.w = np.zeros(shape)

    def update(self, gradient: np.ndarray) -> None:
        grown = self.n + gradient**2
        self.z += gradient - (np.sqrt(grown) - np.sqrt(self.n)) / self.alpha * self.w
        self.n = grown
        rate = (self.beta + np.sqrt(self.n)) / self.alpha + self.l2
        self.w = np.where(np.abs(self.z) > self.l1, -(self.z - np.sign(self.z) * self.l1) / rate, 0.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on the labels, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
