"""Gradient-boosted trees for two classes, on binned features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete binary trees of one depth, node by node in breadth-first order."""

    edges: list[np.ndarray]  # per feature, the upper edges of its bins
    feature: np.ndarray  # trees x inner nodes
    split: np.ndarray  # the last bin that goes left
    leaf: np.ndarray  # trees x leaves
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, split, leaf in zip(self.feature, self.split, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:
                node = 2 * node + 1 + (binned[rows, feature[node]] > split[node])
            total += leaf[node - inner] if len(node) else 0
        return total


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, penalty: float = 2.0
) -> Trees:
    """Boost the logistic loss by Newton steps; every leaf is shrunk by ``penalty``."""
    n, features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    out = Trees(edges, np.zeros((trees, 2**depth - 1), np.int64), np.zeros((trees, 2**depth - 1), np.int64), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    total = np.full(n, out.prior)
    rows = np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 0.0)
            feature, split = np.zeros(width, np.int64), np.full(width, BINS, np.int64)
            for f in range(features):
                cell = (node - first) * BINS + binned[:, f]
                g = np.bincount(cell, grad, width * BINS).reshape(width, BINS)
                h = np.bincount(cell, hess, width * BINS).reshape(width, BINS)
                gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                better = value > best + 1e-9
                best, feature, split = np.where(better, value, best), np.where(better, f, feature), np.where(better, at, split)
            out.feature[t, first : first + width], out.split[t, first : first + width] = feature, split
            node = 2 * node + 1 + (binned[rows, feature[node - first]] > split[node - first])
        inner = 2**depth - 1
        g, h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        out.leaf[t] = rate * g / (h + penalty)
        total += out.leaf[t][node - inner]
    return out
