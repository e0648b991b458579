"""Sparse logistic regression, binary or multinomial, trained with follow-the-regularised-leader."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: (feature indices, values) of one example.
Example = tuple[np.ndarray, np.ndarray]


@dataclass
class FTRL:
    """One weight row a feature, one column a class; elastic-net penalties l1 and l2."""

    features: int
    classes: int
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 1e-4

    def __post_init__(self) -> None:
        self.z = np.zeros((self.features, self.classes))
        self.n = np.zeros((self.features, self.classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, values: np.ndarray, target: np.ndarray, weight: float = 1.0) -> None:
        """One example; indices must be distinct. target: one 0/1 a class."""
        w = self.weights(at)
        scores = values @ w
        p = softmax(scores) if self.classes > 1 else 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
        g = np.outer(values, (p - target) * weight)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, examples: Sequence[Example], targets: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
        """Learn all examples in a fixed shuffled order, `epochs` times; returns the weights."""
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(examples)):
                self.learn(*examples[i], targets[i])
        return self.weights().astype(np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss of softmax(scores / t), by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    if not len(labels):
        return 1.0
    a, b, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
