"""Gradient-boosted trees for two classes, on binned features; small enough for the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Boosted:
    """Complete binary trees: feature and threshold of the inner nodes, values of the leaves."""

    base: float
    depth: int
    features: np.ndarray  # trees x (2^depth - 1)
    thresholds: np.ndarray
    values: np.ndarray  # trees x 2^depth

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.values):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (len(feature))]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0,
    columns: float = 0.4,
) -> Boosted:
    """Logistic loss, second-order gains over histograms; one class alone gives a constant.

    ``least``: smallest sum of second derivatives in a leaf; ``columns``: share of
    the features that a tree may use, drawn anew for each, always alike.
    """
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, n_features = 2**depth - 1, max(1, round(columns * x.shape[1]))
    rng = np.random.default_rng(0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    logit = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(rounds if 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        used = rng.choice(x.shape[1], n_features, replace=False)
        cells = binned[:, used] + np.arange(n_features) * BINS
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            where = ((at - first)[:, None] * (n_features * BINS) + cells).ravel()
            size = width * n_features * BINS
            sums = [np.bincount(where, np.repeat(v, n_features), size).reshape(width, n_features, BINS) for v in (g, h)]
            left_g, left_h = (s.cumsum(2)[:, :, :-1] for s in sums)
            all_g, all_h = (s[:, :1].sum(2, keepdims=True) for s in sums)
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least) | (right_h < least)] = 0
            flat = gain.reshape(width, -1)
            for node, best in enumerate(flat.argmax(1)):
                f, b = divmod(int(best), BINS - 1)
                f = used[f]
                if flat[node, best] > 1e-9 and b < len(edges[f]):
                    feature[first + node], threshold[first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        logit += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    shape = (len(features), inner)
    return Boosted(
        base, depth, np.array(features, np.int64).reshape(shape), np.array(thresholds).reshape(shape),
        np.array(values).reshape(len(values), inner + 1),
    )
