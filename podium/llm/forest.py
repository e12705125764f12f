"""A small random forest on binned features; it is fitted on a bounded sample and applied inside tasks."""

from __future__ import annotations

import numpy as np


class Forest:
    """Binary random forest: bootstrap rows, sqrt(features) tried at each node, Gini gain over quantile bins."""

    def __init__(self, trees: int = 30, depth: int = 8, leaf: int = 3, bins: int = 24, seed: int = 7):
        self.trees, self.depth, self.leaf, self.bins, self.seed, self.nodes = trees, depth, leaf, bins, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        cuts = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T] if len(x) else []
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1) if len(x) else None
        for _ in range(self.trees if len(x) else 0):
            tree: list[list[float]] = []
            self._grow(tree, binned, y, rng.integers(0, len(y), len(y)), 0, cuts, rng)
            self.nodes.append(np.array(tree))
        return self

    def _grow(self, tree, binned, y, rows, depth, cuts, rng) -> int:
        """Appends [feature, cut, left, right, share of ones] and the nodes below it; feature -1: a leaf."""
        me, ones = len(tree), y[rows].mean()
        tree.append([-1, 0, 0, 0, ones])
        if depth == self.depth or len(rows) < 2 * self.leaf or ones in (0, 1):
            return me
        best = (1e-9, -1, 0)
        for f in rng.permutation(binned.shape[1])[: max(2, int(binned.shape[1] ** 0.5) + 1)]:
            k = len(cuts[f])
            if not k:
                continue
            n = np.bincount(binned[rows, f], minlength=k + 1)[:k].cumsum()
            p = np.bincount(binned[rows, f], y[rows], k + 1)[:k].cumsum()
            m, q = len(rows) - n, y[rows].sum() - p
            ok = (n >= self.leaf) & (m >= self.leaf)
            gain = np.where(ok, p * p / np.maximum(n, 1) + q * q / np.maximum(m, 1), 0) - len(rows) * ones**2
            at = int(gain.argmax())
            if ok[at] and gain[at] > best[0]:
                best = (gain[at], f, at)
        _, f, at = best
        if f < 0:
            return me
        low = binned[rows, f] <= at
        left = self._grow(tree, binned, y, rows[low], depth + 1, cuts, rng)
        right = self._grow(tree, binned, y, rows[~low], depth + 1, cuts, rng)
        tree[me] = [f, cuts[f][at], left, right, ones]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of ones over the trees; 0 without trees."""
        total = np.zeros(len(x))
        for t in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = t[at, 0].astype(int)
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(f < 0, at, np.where(go, t[at, 2], t[at, 3]).astype(int))
            total += t[at, 4]
        return total / max(len(self.nodes), 1)
