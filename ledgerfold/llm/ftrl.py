"""Sparse multinomial logistic regression by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class SparseModel:
    """Weights of the slots that the penalties left: (slots, classes); the others are zero."""

    slots: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def table(self, bits: int, dtype=np.float32) -> np.ndarray:
        out = np.zeros((1 << bits, self.weights.shape[1]), dtype)
        out[self.slots] = self.weights
        return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, bits: int, *, alpha: float, beta: float = 1.0, l1: float, l2: float, epochs: int = 2, seed: int = 0) -> SparseModel:
    """rows: of each text the distinct slots and their values. Each is learned from `epochs` times, in an order
    that depends on the seed and the number of rows alone."""
    z, n = np.zeros((1 << bits, classes)), np.zeros((1 << bits, classes))
    zb, nb, bias = np.zeros(classes), np.zeros(classes), np.zeros(classes)

    def weights(z, n):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            slots, x = rows[k]
            zs, ns = z[slots], n[slots]
            w = weights(zs, ns)
            p = softmax(x @ w + bias)
            p[y[k]] -= 1
            g = x[:, None] * p
            z[slots] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[slots] = ns + g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * bias
            nb += p * p
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    w = weights(z, n)
    kept = np.flatnonzero(w.any(axis=1))
    return SparseModel(kept, w[kept], bias)
