"""Small gradient-boosted trees on binned features, for models that fit on one bounded sample."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with depth-limited trees stored as arrays."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: float = 3.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base, f = float(np.log(p / (1 - p))), np.full(len(y), np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0.03, 0.97, 24))) for c in x.T] if len(y) else []
        for _ in range(self.rounds if len(y) else 0):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - q, q * (1 - q), cuts)
            f += self.rate * self._walk(tree, x)
            self.trees.append(tree)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        """Rows (feature or -1, cut, left, value); right follows left."""
        nodes = [[-1, 0.0, 0, 0.0]]
        todo = [(0, np.arange(len(g)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes[at][3] = gs / (hs + 1.0)
            if depth == self.depth or len(rows) < 2 * self.least:
                continue
            best = (1e-6, None, None)
            for j, c in enumerate(cuts):
                bin_ = np.searchsorted(c, x[rows, j], side="left")
                gl, hl, nl = (np.cumsum(np.bincount(bin_, v, minlength=len(c) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, c[gain.argmax()])
            if best[1] is None:
                continue
            goes = x[rows, best[1]] <= best[2]
            nodes[at][:3] = [best[1], best[2], len(nodes)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            todo += [(nodes[at][2], rows[goes], depth + 1), (nodes[at][2] + 1, rows[~goes], depth + 1)]
        return np.array(nodes)

    @staticmethod
    def _walk(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            feature = tree[at, 0].astype(np.int64)
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return tree[at, 3]
            left = x[inner, feature[inner]] <= tree[at[inner], 1]
            at[inner] = tree[at[inner], 2].astype(np.int64) + ~left

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        f = np.full(len(x), self.base)
        for t in self.trees:
            f += self.rate * self._walk(t, x)
        return f
