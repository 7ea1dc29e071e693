"""Gradient-boosted trees for small tables of features, with logistic loss and calibrated scores."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8) -> None:
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list[list[tuple]] = []
        self.scale, self.shift, self.start = 1.0, 0.0, 0.0

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, nodes: list[tuple]) -> int:
        at = len(nodes)
        nodes.append(())
        value = g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None, 0.0)
        if depth and len(rows) >= 2 * self.least:
            base = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                gs, hs = np.cumsum(g[order]), np.cumsum(h[order])
                cut = np.flatnonzero(v[1:] != v[:-1])
                cut = cut[(cut + 1 >= self.least) & (len(rows) - cut - 1 >= self.least)]
                if len(cut):
                    gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - base
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] is None:
            nodes[at] = (-1, value, 0, 0)
            return at
        side = x[rows, best[1]] <= best[2]
        low = self._grow(x, g, h, rows[side], depth - 1, nodes)
        high = self._grow(x, g, h, rows[~side], depth - 1, nodes)
        nodes[at] = (best[1], best[2], low, high)
        return at

    def _tree(self, nodes: list[tuple], x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, v, low, high = nodes[node]
            if f < 0:
                out[rows] = v
            else:
                side = x[rows, f] <= v
                todo += [(low, rows[side]), (high, rows[~side])]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(x), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            nodes: list[tuple] = []
            self._grow(x, y - p, p * (1 - p), np.arange(len(x)), self.depth, nodes)
            self.trees.append(nodes)
            score += self.rate * self._tree(nodes, x)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._tree(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt's sigmoid on held-out rows, by Newton steps."""
        s, w = self.raw(x), np.array([1.0, 0.0])
        a = np.column_stack([s, np.ones(len(s))])
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            grad = a.T @ (t - p) - 1e-3 * w
            hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
        self.scale, self.shift = float(w[0]), float(w[1])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score above which held-out precision is at least as wanted; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)  # a tie is kept or left as a whole
    ok = np.flatnonzero((right >= precision) & last)
    return float(p[order][ok[-1]]) if len(ok) else 1.1
