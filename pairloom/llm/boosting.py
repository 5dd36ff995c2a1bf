"""Gradient-boosted trees for two classes on a bounded table of features, in numpy."""

from __future__ import annotations

import numpy as np

ROUNDS, LEVELS, RATE, BINS, RIDGE, LEAST = 60, 4, 0.25, 32, 1.0, 8


class Trees:
    """Complete trees of ``LEVELS`` levels: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, base: float, features: np.ndarray, thresholds: np.ndarray, leaves: np.ndarray):
        self.base, self.features, self.thresholds, self.leaves = base, features, thresholds, leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (x[rows, features[at]] > thresholds[at])
            total += leaves[at - (2**LEVELS - 1)]
        return total


def _best_split(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature and bin of the best split of some rows (codes: rows x features)."""
    n, width = codes.shape
    flat = (codes + np.arange(width) * BINS).ravel()
    g, h, c = (np.bincount(flat, np.repeat(v, width), width * BINS).reshape(width, BINS).cumsum(1) for v in (grad, hess, np.ones(n)))
    total_g, total_h = g[:, -1:], h[:, -1:]
    gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
    gain[(c < LEAST) | (n - c < LEAST)] = 0.0
    k = int(gain.argmax())
    return float(gain.flat[k]), k // BINS, k % BINS


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss; splits lie between quantiles of each feature."""
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0) if len(x) else np.zeros((BINS - 1, x.shape[1]))
    codes = np.stack([np.searchsorted(edges[:, k], x[:, k], side="left") for k in range(x.shape[1])], axis=1)
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(rate / (1 - rate)))
    odds, inner = np.full(len(y), base), 2**LEVELS - 1
    features, thresholds = np.zeros((ROUNDS, inner), np.int64), np.full((ROUNDS, inner), np.inf)
    leaves = np.zeros((ROUNDS, inner + 1))
    for r in range(ROUNDS):
        p = 1 / (1 + np.exp(-odds))
        grad, hess = p - y, p * (1 - p)
        members = {0: np.arange(len(y))}
        for node in range(inner):
            rows = members.pop(node, np.empty(0, np.int64))
            right = np.zeros(len(rows), bool)
            if len(rows) >= 2 * LEAST:
                gain, k, cut = _best_split(codes[rows], grad[rows], hess[rows])
                if gain > 1e-6 and cut < BINS - 1:
                    features[r, node], thresholds[r, node] = k, edges[cut, k]
                    right = codes[rows, k] > cut
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
        for leaf, rows in members.items():
            if len(rows):
                value = -RATE * grad[rows].sum() / (hess[rows].sum() + RIDGE)
                leaves[r, leaf - inner] = value
                odds[rows] += value
    return Trees(base, features, thresholds, leaves)
