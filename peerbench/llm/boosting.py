"""Gradient-boosted trees on a bounded matrix of dense features, and isotonic calibration of their margins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosting:
    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    least_weight: float = 2.0


@dataclass
class Trees:
    """Perfect binary trees: node i of a tree has the children 2 i + 1 and 2 i + 2; a row goes right if its
    feature is above the node's cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, params: Boosting = Boosting()) -> Trees:
    """Trees for the logistic loss, by Newton steps on histograms. ``y`` is 0 or 1, with rows of both."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, params.bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], axis=1)
    rate = y.mean()
    base = float(np.log(rate / (1 - rate)))
    inner = (1 << params.depth) - 1
    out = Trees(base, np.zeros((params.trees, inner), np.int64), np.full((params.trees, inner), np.inf), np.zeros((params.trees, inner + 1)))
    margin = np.full(n, base)
    for t in range(params.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(params.depth):
            first = (1 << level) - 1
            size = 1 << level
            best = np.full(size, 1e-6)
            for j in range(width):
                if not len(edges[j]):
                    continue
                cell = (node - first) * params.bins + binned[:, j]
                gs = np.bincount(cell, g, size * params.bins).reshape(size, -1).cumsum(axis=1)
                hs = np.bincount(cell, h, size * params.bins).reshape(size, -1).cumsum(axis=1)
                whole_g, whole_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + params.ridge) + (whole_g - gs) ** 2 / (whole_h - hs + params.ridge) - whole_g**2 / (whole_h + params.ridge)
                gain[(hs < params.least_weight) | (whole_h - hs < params.least_weight)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(size), at] > best
                best = np.where(better, gain[np.arange(size), at], best)
                k = first + np.flatnonzero(better)
                out.feature[t, k], out.cut[t, k] = j, edges[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.cut[t, node])
        leaf = node - inner
        out.leaf[t] = params.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + params.ridge)
        margin += out.leaf[t, leaf]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, share of 1) of the non-decreasing step function of least squares, by pooling adjacent
    violators; between the steps it is read off the line that joins them."""
    at, inverse = np.unique(margin, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []
    for lo, total, w in zip(at, np.bincount(inverse, y), weight):
        blocks.append([lo, lo, total, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, s, w2 = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += s
            blocks[-1][3] += w2
    knots = [(x, s / w) for lo, hi, s, w in blocks for x in dict.fromkeys((lo, hi))]
    return np.array([x for x, _ in knots]), np.array([v for _, v in knots])
