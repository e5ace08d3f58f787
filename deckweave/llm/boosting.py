"""Gradient-boosted trees for a bounded training sample, and their evaluation in numpy."""

from dataclasses import dataclass

import numpy as np

ROUNDS, DEPTH, BINS, RATE = 60, 4, 32, 0.2
#: Regularisation of leaf values, and least sum of second derivatives on a side of a split.
RIDGE, LEAST = 1.0, 4.0


@dataclass(frozen=True)
class Boosted:
    """Complete binary trees of one depth: split features and thresholds by level, values of leaves."""

    base: float
    features: np.ndarray  # trees x inner nodes
    thresholds: np.ndarray
    values: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for feature, threshold, value in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Boosted:
    """Trees for the logistic loss, split at quantiles by second-order gains."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    codes = np.stack([np.searchsorted(cut, x[:, k], side="left") for k, cut in enumerate(cuts)], axis=1)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(rate / (1 - rate)))
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    margin = np.full(n, base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            top = np.full(count, 1e-6)
            for k in range(width):
                if not len(cuts[k]):
                    continue
                key = local * (BINS + 1) + codes[:, k]
                gs = np.bincount(key, g, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                hs = np.bincount(key, h, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                g_all, h_all = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, : len(cuts[k])], hs[:, : len(cuts[k])]
                gain = gl**2 / (hl + RIDGE) + (g_all - gl) ** 2 / (h_all - hl + RIDGE) - g_all**2 / (h_all + RIDGE)
                gain[(hl < LEAST) | (h_all - hl < LEAST)] = -1
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                better = np.flatnonzero(value > top)
                top[better] = value[better]
                features[t, first + better] = k
                thresholds[t, first + better] = cuts[k][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += values[t][leaf]
    return Boosted(base, features, thresholds, values)
