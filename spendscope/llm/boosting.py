"""Gradient-boosted trees of fixed depth for two classes, in numpy: histogram splits, logistic loss.

Defined cases: features are finite numbers, which callers see to (not-a-number would pass no cut
and spoil the quantiles); equal gains go to the first feature, then to the lowest cut; a node that no cut
improves keeps its rows together; without rows, or with one label only, the trees are a constant.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    value: np.ndarray  # (trees, leaves)
    base: float
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    """Trees for labels 0 and 1; with one label only, or without rows, a constant."""
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else 6.0 * (2 * float(y[0]) - 1)
        return Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), base, depth)
    share = float(np.average(y, weights=weight))
    base = float(np.log(share / (1 - share)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    offset = np.arange(width) * bins
    logit, inner = np.full(len(y), base), 2**depth - 1
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base, depth)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cell = ((at - first) * (width * bins))[:, None] + offset + binned
            sums = [np.bincount(cell.ravel(), np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins) for v in (grad, hess)]
            g, h = (np.cumsum(s, 2) for s in sums)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1.0
            best = gain.reshape(nodes, -1).argmax(1)
            f, b = np.divmod(best, bins)
            for k in range(nodes):
                if gain.reshape(nodes, -1)[k, best[k]] > 1e-9:
                    out.feature[t, first + k], out.cut[t, first + k] = f[k], edges[f[k]][b[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), out.feature[t, at]] > out.cut[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        out.value[t] = rate * g / (h + ridge)
        logit += out.value[t][leaf]
    return out
