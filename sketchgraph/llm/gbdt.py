"""Gradient-boosted trees on histograms of binned features, with logistic loss.

Trees are complete binary trees of one depth, stored as flat arrays in level order; rows go down all of them by
vectorised index arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """feature and threshold: a row of inner nodes for each tree; value: a row of leaves. A row with x[feature] > threshold goes right."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray, block: int = 8192) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        trees = np.arange(len(self.feature))[None, :]
        for i in range(0, len(x) if len(trees[0]) else 0, block):
            part = x[i : i + block]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[i : i + block] += self.value[trees, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Trees for features x (rows, columns) and labels y (0 or 1). least: rows, as hessian weight times 4, that a leaf needs.

    Without rows or with one label alone the model is a constant, 0.5 without rows.
    """
    n, columns = x.shape
    inner, mean = (1 << depth) - 1, (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not n or y.min() == y.max():
        return Trees(feature[:0], threshold[:0], value[:0], base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(columns)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # bin > i exactly if x > cuts[i]
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-6)
            sums = np.bincount(node, g, width), np.bincount(node, h, width)
            where = np.full(width, -1), np.zeros(width, np.int64)
            for j in range(columns):
                if not (m := len(cuts[j])):
                    continue
                at = node * (m + 1) + binned[j]
                gl, hl = (np.bincount(at, w, width * (m + 1)).reshape(width, m + 1).cumsum(1)[:, :-1] for w in (g, h))
                gr, hr = sums[0][:, None] - gl, sums[1][:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (sums[0] ** 2 / (sums[1] + ridge))[:, None]
                gain[(hl * 4 < least) | (hr * 4 < least)] = 0
                cut = gain.argmax(1)
                better = gain[np.arange(width), cut] > best
                best[better] = gain[np.arange(width), cut][better]
                where[0][better], where[1][better] = j, cut[better]
            right = np.zeros(n, bool)
            for k in np.flatnonzero(where[0] >= 0):
                j, cut = where[0][k], where[1][k]
                feature[t, first + k], threshold[t, first + k] = j, cuts[j][cut]
                right |= (node == k) & (binned[j] > cut)
            node = 2 * node + right
        value[t] = rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + ridge)
        total += value[t][node]
    return Trees(feature, threshold, value, base)
