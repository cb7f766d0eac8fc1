"""Gradient-boosted trees for two classes on a bounded table of training rows."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth over binned features, fitted to the logistic loss by its two slopes."""

    def __init__(self, rounds: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.25,
                 smooth: float = 1.0):
        self.rounds, self.depth, self.bins, self.rate, self.smooth = (
            rounds, depth, bins, rate, smooth)
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f, edges in enumerate(self.edges):
            out[:, f] = np.searchsorted(edges, x[:, f], side="left")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._apply(tree, binned)
        return self

    def _grow(self, binned: np.ndarray, slope: np.ndarray, curve: np.ndarray):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int32), np.full(inner, 255, np.uint8)
        at = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-6)
            for f in range(binned.shape[1]):
                slot = (at - first) * self.bins + binned[:, f]
                g = np.bincount(slot, slope, count * self.bins).reshape(count, -1).cumsum(axis=1)
                h = np.bincount(slot, curve, count * self.bins).reshape(count, -1).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = (g ** 2 / (h + self.smooth) + (gt - g) ** 2 / (ht - h + self.smooth)
                        - gt ** 2 / (ht + self.smooth))
                k = gain.argmax(axis=1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better] = top[better]
                feature[first:first + count][better] = f
                cut[first:first + count][better] = k[better]
            right = binned[np.arange(len(at)), feature[at]] > cut[at]
            at = 2 * at + 1 + right
        leaf = at - inner
        g = np.bincount(leaf, slope, 1 << self.depth)
        h = np.bincount(leaf, curve, 1 << self.depth)
        return feature, cut, -self.rate * g / (h + self.smooth)

    def _apply(self, tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, leaves = tree
        at = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        return leaves[at - len(feature)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.base + sum(self._apply(t, binned) for t in self.trees)
