"""Small tree learners in numpy: a decision tree, and gradient boosted trees for two classes."""

from __future__ import annotations

import numpy as np


class Tree:
    """Regression tree on weighted squares; splits at midpoints, the best gain first, ties to the first feature."""

    def __init__(self, depth: int, min_rows: int = 5):
        self.depth, self.min_rows = depth, min_rows
        self.nodes: list[tuple[int, float, int, int, float]] = []  # feature, cut, left, right, value

    def fit(self, x: np.ndarray, y: np.ndarray, curvature: np.ndarray | None = None) -> Tree:
        """``y`` is the target; with ``curvature`` a leaf holds sum(y) / sum(curvature)."""
        h = np.ones(len(y)) if curvature is None else curvature
        self.nodes = []
        self._grow(x, y, h, np.arange(len(y)), self.depth)
        return self

    def _grow(self, x, y, h, rows, depth) -> int:
        at = len(self.nodes)
        total, weight = y[rows].sum(), h[rows].sum() + 1e-9
        self.nodes.append((-1, 0.0, -1, -1, float(total / weight)))
        best = (1e-9, -1, 0.0)
        if depth and len(rows) >= 2 * self.min_rows:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                g, w = np.cumsum(y[order])[:-1], np.cumsum(h[order])[:-1] + 1e-9
                gain = g**2 / w + (total - g) ** 2 / (weight - w + 2e-9) - total**2 / weight
                n = np.arange(1, len(order))
                gain[(v[1:] == v[:-1]) | (n < self.min_rows) | (len(order) - n < self.min_rows)] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            left = rows[x[rows, best[1]] <= best[2]]
            right = rows[x[rows, best[1]] > best[2]]
            l, r = self._grow(x, y, h, left, depth - 1), self._grow(x, y, h, right, depth - 1)
            self.nodes[at] = (best[1], best[2], l, r, self.nodes[at][4])
        return at

    def value(self, row) -> float:
        at = 0
        while True:
            feature, cut, left, right, value = self.nodes[at]
            if feature < 0:
                return value
            at = left if row[feature] <= cut else right


class Boosted:
    """Boosted trees under logistic loss, with thresholds per group calibrated for precision on rows kept apart."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3):
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.base, self.trees, self.thresholds = 0.0, [], {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = Tree(self.depth).fit(x, y - p, p * (1 - p) + 1e-6)
            self.trees.append(tree)
            z += self.rate * np.array([np.clip(tree.value(r), -4, 4) for r in x])
        return self

    def score(self, row) -> float:
        z = self.base + sum(self.rate * min(4.0, max(-4.0, t.value(row))) for t in self.trees)
        return float(1 / (1 + np.exp(-z)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, groups: list[str], precision: float = 0.98) -> None:
        """Per group the score from which on the share of true rows is at least ``precision``: midway to the next lower one."""
        found = np.array([self.score(r) for r in x])
        for group in sorted(set(groups)):
            mine = np.array([g == group for g in groups])
            order = np.argsort(-found[mine], kind="stable")
            s, t = found[mine][order], y[mine][order]
            right = np.cumsum(t) / np.arange(1, len(t) + 1)
            good = np.flatnonzero(right >= precision)
            last = int(good[-1]) if len(good) else -1
            below = s[last + 1] if last + 1 < len(s) else 0.0
            self.thresholds[group] = float((s[last] + below) / 2) if last >= 0 else 2.0
