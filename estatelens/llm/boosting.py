"""Gradient-boosted trees for two classes, on a bounded table in one process."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Regression trees of fixed depth on binned features, each fitted to the logistic loss left."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 16):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = np.quantile(x, shares, axis=0).T
        binned = self.binned(x)
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(len(y), self.prior)
        nodes = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, nodes), dtype=np.int64)
        self.cut = np.full((self.trees, nodes), self.bins, dtype=np.int64)
        self.leaf = np.zeros((self.trees, 1 << self.depth))
        for tree in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            at = np.zeros(len(y), dtype=np.int64)  # node of each row, within its level
            for level in range(self.depth):
                self.split(tree, level, binned, gradient, weight, at)
                node = at + (1 << level) - 1
                right = binned[np.arange(len(y)), self.feature[tree, node]] > self.cut[tree, node]
                at = 2 * at + right
            g = np.bincount(at, gradient, 1 << self.depth)
            w = np.bincount(at, weight, 1 << self.depth)
            self.leaf[tree] = self.rate * g / (w + 1.0)
            score += self.leaf[tree][at]
        return self

    def split(self, tree, level, binned, gradient, weight, at) -> None:
        """The best cut of every node of a level."""
        size = (1 << level, self.bins)
        best = np.full(size[0], 1e-6)
        start = (1 << level) - 1
        for f in range(binned.shape[1]):
            place = at * self.bins + binned[:, f]
            g = np.bincount(place, gradient, size[0] * self.bins).reshape(size).cumsum(axis=1)
            w = np.bincount(place, weight, size[0] * self.bins).reshape(size).cumsum(axis=1)
            rest_g, rest_w = g[:, -1:] - g, w[:, -1:] - w
            gain = g**2 / (w + 1) + rest_g**2 / (rest_w + 1) - g[:, -1:] ** 2 / (w[:, -1:] + 1)
            cut = gain.argmax(axis=1)
            value = gain[np.arange(size[0]), cut]
            better = value > best
            best[better] = value[better]
            nodes = start + np.flatnonzero(better)
            self.feature[tree, nodes], self.cut[tree, nodes] = f, cut[better]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(self.cuts[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1
        )

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive class."""
        binned = self.binned(x)
        rows = np.arange(len(x))
        score = np.full(len(x), self.prior)
        for tree in range(self.trees):
            at = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                node = at + (1 << level) - 1
                at = 2 * at + (binned[rows, self.feature[tree, node]] > self.cut[tree, node])
            score += self.leaf[tree][at]
        return score
