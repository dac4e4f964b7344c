"""Gradient-boosted trees and isotonic calibration for small dense samples."""

from __future__ import annotations

import numpy as np

from tidegauge.llm.common import sigmoid


class BoostedTrees:
    """Logistic boosting of shallow trees on binned features.

    A tree is kept in heap order; ``feature`` -1 marks a leaf.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
                 bins: int = 32, ridge: float = 1.0, least_rows: int = 5):
        self.depth = depth
        nodes = 2 ** (depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int16)
        self.cut = np.zeros((trees, nodes))
        self.value = np.zeros((trees, nodes))
        rate_1 = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(rate_1 / (1 - rate_1)))
        if not len(y) or y.min() == y.max():
            return
        cuts = [np.unique(np.quantile(c[c > c.min()] if (c > c.min()).any() else c, np.linspace(0, 1, bins - 1)))
                for c in x.T]
        binned = np.column_stack([np.searchsorted(k, c, side="right") for k, c in zip(cuts, x.T)])
        margin = np.full(len(y), self.start)
        for t in range(trees):
            p = sigmoid(margin)
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            for i in range(nodes):
                rows = np.nonzero(node == i)[0]
                if not len(rows):
                    continue
                self.value[t, i] = rate * g[rows].sum() / (h[rows].sum() + ridge)
                if 2 * i + 2 >= nodes or len(rows) < 2 * least_rows:
                    continue
                f, b = self._split(binned[rows], g[rows], h[rows], bins, ridge, least_rows)
                if f < 0:
                    continue
                self.feature[t, i], self.cut[t, i] = f, cuts[f][b]
                node[rows] = 2 * i + 1 + (binned[rows, f] > b)
            margin += self.value[t, node]

    @staticmethod
    def _split(binned, g, h, bins, ridge, least_rows):
        best, where = 1e-6, (-1, 0)
        total_g, total_h = g.sum(), h.sum()
        for f in range(binned.shape[1]):
            column = binned[:, f]
            gl = np.cumsum(np.bincount(column, g, bins + 1))[:-1]
            hl = np.cumsum(np.bincount(column, h, bins + 1))[:-1]
            nl = np.cumsum(np.bincount(column, minlength=bins + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge)
            gain = np.where((nl >= least_rows) & (len(g) - nl >= least_rows), gain, -np.inf)
            b = int(np.argmax(gain))
            if gain[b] - total_g**2 / (total_h + ridge) > best:
                best, where = gain[b] - total_g**2 / (total_h + ridge), (f, b)
        return where

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                step = 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= cut[node])
                node = np.where(f < 0, node, step)
            out += value[node]
        return out


class Isotonic:
    """Shares of label 1 that never fall with the margin, by pooling adjacent violators."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        self.at = np.zeros(0)
        if not len(y) or y.min() == y.max():
            return
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, sum of margins
        for m, v in zip(margin[order], y[order].astype(float)):
            blocks.append([v, 1.0, m])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                a, b = blocks[-2], blocks.pop()
                w = a[1] + b[1]
                a[:] = [(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]]
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.share = np.array([(b[0] * b[1] + 0.01) / (b[1] + 0.02) for b in blocks])

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        plain = sigmoid(margin)
        if not len(self.at):
            return plain
        # A trace of the margin keeps the order inside flat pieces.
        return 0.999 * np.interp(margin, self.at, self.share) + 0.001 * plain
