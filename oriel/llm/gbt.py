"""Gradient-boosted trees for two classes, on numpy: histogram splits, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    least: int = 20
    shrink: float = 1.0
    start: float = 0.0
    #: One (feature, threshold, value) triple of heap-ordered arrays a tree; a feature of -1 is a leaf.
    forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(n, self.start)
        size = 2 ** (self.depth + 1)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-9)
            feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.ones(n, np.int64)
            for level in range(self.depth + 1):
                for k in range(2**level, 2 ** (level + 1)):
                    rows = np.flatnonzero(node == k)
                    if not len(rows):
                        continue
                    g, h = grad[rows].sum(), hess[rows].sum()
                    value[k] = -self.rate * g / (h + self.shrink)
                    if level == self.depth or len(rows) < 2 * self.least:
                        continue
                    best = (1e-6, -1, 0)
                    for j in range(f):
                        if not len(edges[j]):
                            continue
                        m = len(edges[j]) + 1
                        gl = np.cumsum(np.bincount(codes[rows, j], grad[rows], m))[:-1]
                        hl = np.cumsum(np.bincount(codes[rows, j], hess[rows], m))[:-1]
                        cl = np.cumsum(np.bincount(codes[rows, j], minlength=m))[:-1]
                        gain = gl**2 / (hl + self.shrink) + (g - gl) ** 2 / (h - hl + self.shrink) - g * g / (h + self.shrink)
                        gain[(cl < self.least) | (len(rows) - cl < self.least)] = -1
                        i = int(np.argmax(gain))
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, i)
                    if best[1] >= 0:
                        feature[k], threshold[k] = best[1], edges[best[1]][best[2]]
                        node[rows] = 2 * k + (codes[rows, best[1]] > best[2])
            self.forest.append((feature, threshold, value))
            score += self._one(self.forest[-1], x)
        return self

    def _one(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        at = np.ones(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            j = feature[at]
            right = x[rows, np.maximum(j, 0)] > threshold[at]
            at = np.where(j >= 0, 2 * at + right, at)
        return value[at]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._one(t, x) for t in self.forest), np.zeros(len(x)))
