"""Small gradient-boosted trees for binary labels, fitted on the driver, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, depth-limited regression trees with Newton leaves, exact splits on few-valued features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self.rate * self._walk(tree, x)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        sg, sh = g[rows].sum(), h[rows].sum()
        best = (1e-3, None, None)
        if depth:
            for f, values in enumerate(cuts):
                if not len(values):
                    continue
                bin_ = np.searchsorted(values, x[rows, f], "left")  # bin_ <= k: the value is at most values[k]
                lg, lh = (np.cumsum(np.bincount(bin_, w, len(values) + 1))[:-1] for w in (g[rows], h[rows]))
                gain = lg**2 / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg**2 / (sh + 1)
                gain[(lh < self.least) | (sh - lh < self.least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, values[k])
        if best[1] is None:
            return sg / (sh + 1)
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, cuts, rows[low], depth - 1), self._grow(x, g, h, cuts, rows[~low], depth - 1))

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._walk(low, x), self._walk(high, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and intercept of a logistic calibration of held-out margins."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g, w = p - y, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[np.sum(w * margin**2) + 1e-3, np.sum(w * margin)], [np.sum(w * margin), np.sum(w) + 1e-3]])
        step = np.linalg.solve(hess, [np.sum(g * margin) + 1e-3 * (a - 1), np.sum(g)])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
