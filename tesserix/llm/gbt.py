"""Gradient-boosted trees on the logistic loss, small enough to train on the driver in a second."""

from __future__ import annotations

import numpy as np


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, l2: float, cuts: list[np.ndarray]):
    value = float(g[rows].sum() / (h[rows].sum() + l2))
    if depth == 0 or len(rows) < 20:
        return value
    best, gs, hs = (1e-6, -1, 0.0), g[rows].sum(), h[rows].sum()
    parent = gs * gs / (hs + l2)
    for j, points in enumerate(cuts):
        col = x[rows, j]
        for c in points:
            left = col <= c
            n = int(left.sum())
            if n < 8 or n > len(rows) - 8:
                continue
            gl, hl = g[rows][left].sum(), h[rows][left].sum()
            gain = gl * gl / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - parent
            if gain > best[0]:
                best = (float(gain), j, float(c))
    if best[1] < 0:
        return value
    left = x[rows, best[1]] <= best[2]
    return best[1], best[2], _tree(x, g, h, rows[left], depth - 1, l2, cuts), _tree(x, g, h, rows[~left], depth - 1, l2, cuts)


def _walk(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


class Boosted:
    """Trees, and a logistic calibration fitted on rows that the trees have not seen."""

    def __init__(self, rounds: int = 25, depth: int = 3, rate: float = 0.3, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.l2 = rounds, depth, rate, l2
        self.trees: list = []
        self.a, self.b = 1.0, 0.0

    def margin(self, row) -> float:
        return sum(self.rate * _walk(t, row) for t in self.trees)

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Boosted:
        tx, ty = x[~held], y[~held]
        cuts = [np.unique(np.quantile(tx[:, j], np.linspace(0, 1, 9)[:-1])) for j in range(tx.shape[1])]
        m = np.zeros(len(ty))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-m))
            t = _tree(tx, ty - p, p * (1 - p), np.arange(len(ty)), self.depth, self.l2, cuts)
            self.trees.append(t)
            m += self.rate * np.array([_walk(t, r) for r in tx])
        hm, hy = np.array([self.margin(r) for r in x[held]]), y[held]
        for _ in range(200):  # Platt scaling
            p = 1 / (1 + np.exp(-(self.a * hm + self.b)))
            self.a += 0.5 * float(((hy - p) * hm).mean()) / max(1.0, float((hm * hm).mean()))
            self.b += 0.5 * float((hy - p).mean())
        return self

    def probability(self, row) -> float:
        return 1 / (1 + np.exp(-(self.a * self.margin(row) + self.b)))
