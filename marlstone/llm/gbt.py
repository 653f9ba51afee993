"""Histogram gradient-boosted trees: fitted on a bounded sample, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees of one depth. Node k's children are 2k+1 and 2k+2; a row goes right if its feature exceeds the threshold."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums of the leaves that each row of ``x`` reaches: one vectorised step for each tree and level."""
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def sql(self, names: list[str]) -> str:
        """The margin as an SQL expression over the named features."""

        def node(tree: int, k: int) -> str:
            if k >= self.feature.shape[1]:
                return repr(round(float(self.leaf[tree, k - self.feature.shape[1]]), 6)) + "D"
            t = float(self.threshold[tree, k])
            if not np.isfinite(t):  # nothing goes right
                return node(tree, 2 * k + 1)
            return f"CASE WHEN {names[self.feature[tree, k]]} > {t!r}D THEN {node(tree, 2 * k + 2)} ELSE {node(tree, 2 * k + 1)} END"

        return " + ".join([f"{self.base!r}D", *(f"({node(i, 0)})" for i in range(len(self.leaf)))])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> Forest:
    """Boosts the log loss of labels 0 and 1. Needs at least one row of each; otherwise the forest is a constant."""
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    p = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(p / (1 - p)))
    feature, threshold, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Forest(base, feature, threshold, leaf)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(n, base)
    offsets = np.arange(width) * bins
    for i in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first) * width * bins)[:, None] + offsets + binned
            g = np.bincount(slot.ravel(), np.repeat(grad, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
            h = np.bincount(slot.ravel(), np.repeat(hess, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(h < least / 4) | (ht - h < least / 4)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[i, first + k], threshold[i, first + k] = j, cuts[j][b]
            f, t = feature[i, node], threshold[i, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > t)
        at = node - inner
        value = rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + l2)
        leaf[i] = value
        margin += value[at]
    return Forest(base, feature, threshold, leaf)
