"""Gradient-boosted trees for two classes, in numpy: histogram splits, logistic loss, calibrated by isotonic regression."""

from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, most + 1)[1:-1])) for j in range(x.shape[1])]


class BoostedTrees:
    """Full binary trees of one depth; a node that can't gain sends all its rows left."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 16, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = _bins(x, self.bins)
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        width = self.bins + 1
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, trees = np.full(len(y), self.prior), []
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), int)
            feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.full(n, 1e-9)
                gt, ht = np.bincount(node, g, n), np.bincount(node, h, n)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = node * width + binned[:, j]
                    gl = np.cumsum(np.bincount(key, g, n * width).reshape(n, width), 1)
                    hl = np.cumsum(np.bincount(key, h, n * width).reshape(n, width), 1)
                    gr, hr = gt[:, None] - gl, ht[:, None] - hl
                    gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - (gt**2 / (ht + self.l2))[:, None]
                    gain[:, len(c) :] = -1
                    at = gain.argmax(1)
                    value = gain[np.arange(n), at]
                    for k in np.flatnonzero(value > best):
                        best[k], feature[first + k], cut[first + k] = value[k], j, c[at[k]]
                node = node * 2 + (x[np.arange(len(y)), feature[first + node]] > cut[first + node])
            leaves = -self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.l2)
            score = score + leaves[node]
            trees.append((feature, cut, leaves))
        self.trees = trees
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, leaves in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                k = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[k]] > cut[k])
            out += leaves[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Isotonic regression of held-out labels on raw scores (pool adjacent violators)."""
        order = np.argsort(self.raw(x), kind="stable")
        s, blocks = self.raw(x)[order], []
        for v, t in zip(y[order].astype(float), s, strict=True):
            blocks.append([v, 1.0, t])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                v2, n2, t2 = blocks.pop()
                v1, n1, _ = blocks.pop()
                blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, t2])
        self.levels = np.array([(v * n + 0.5) / (n + 1) for v, n, _ in blocks])
        self.levels = np.maximum.accumulate(self.levels)
        self.upto = np.array([t for _, _, t in blocks])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return self.levels[np.minimum(np.searchsorted(self.upto, self.raw(x), side="left"), len(self.levels) - 1)]

    def threshold(self, x: np.ndarray, y: np.ndarray, precision: float) -> float:
        """The lowest probability from which on held-out precision is at least ``precision``."""
        p = self.probability(x)
        for t in np.unique(p):
            if y[p >= t].mean() >= precision:
                return float(t)
        return 1.1
