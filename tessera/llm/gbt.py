"""Histogram gradient-boosted trees for two classes, in numpy: fitted on binned columns, flattened for traversal of many rows and all trees at once."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of one depth as arrays: a row a tree, nodes in heap order; rows go right where a feature exceeds the threshold."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def logit(self, x: np.ndarray) -> np.ndarray:
        n, depth = len(x), int(np.log2(self.leaf.shape[1]))
        tree, row = np.arange(len(self.leaf))[None, :], np.arange(n)[:, None]
        at = np.zeros((n, len(self.leaf)), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.leaf[tree, at - (self.leaf.shape[1] - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Trees:
    """Newton boosting of the log loss. Where there are no rows, every score is 1/2; where there is one class, its share (smoothed)."""
    n, m = x.shape
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(feature, threshold, leaf, base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.int64)
    f = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for d in range(depth):
            first, width = (1 << d) - 1, 1 << d
            node = at - first
            best = np.full(width, 1e-6)
            for j in range(m):
                k = node * bins + binned[:, j]
                gs, hs, cs = (np.bincount(k, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(cs < least) | (ct - cs < least)] = -1
                gain = gain[:, : len(edges[j])]
                if not gain.size:
                    continue
                cut = gain.argmax(axis=1)
                gain = gain[np.arange(width), cut]
                better = np.flatnonzero(gain > best)
                best[better] = gain[better]
                feature[t, first + better] = j
                threshold[t, first + better] = edges[j][cut[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        k = at - inner
        leaf[t] = -rate * np.bincount(k, g, leaves) / (np.bincount(k, h, leaves) + ridge)
        f += leaf[t, k]
    return Trees(feature, threshold, leaf, base)
