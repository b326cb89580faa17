"""Small gradient-boosted trees over NumPy arrays, for models fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    base: float
    #: For each tree: feature, cut and leaf value of its nodes in heap order.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                node[inner] = 2 * at + 1 + (x[inner, feature[at]] > cut[at])
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 4, rate: float = 0.2, penalty: float = 1.0) -> Boosted:
    """Logistic loss, exact cuts between distinct values."""
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    margin, grown = np.full(len(y), base), []
    cuts = [(u[1:] + u[:-1]) / 2 if len(u := np.unique(x[:, f])) <= 64 else np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    size = 2 ** (depth + 1) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for k in range(size):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            value[k] = rate * g[own].sum() / (h[own].sum() + penalty)
            if k >= 2**depth - 1:
                continue
            best = 1e-6
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = np.searchsorted(c, x[own, f], side="left")
                gl = np.bincount(b, weights=g[own], minlength=len(c) + 1).cumsum()
                hl = np.bincount(b, weights=h[own], minlength=len(c) + 1).cumsum()
                gain = gl[:-1] ** 2 / (hl[:-1] + penalty) + (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + penalty) - gl[-1] ** 2 / (hl[-1] + penalty)
                gain[(hl[:-1] < 0.5) | (hl[-1] - hl[:-1] < 0.5)] = 0
                if gain.max() > best:
                    best, feature[k], cut[k] = gain.max(), f, c[gain.argmax()]
            if feature[k] >= 0:
                node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
        margin += value[node]
        grown.append((feature, cut, value))
    return Boosted(base, grown)
