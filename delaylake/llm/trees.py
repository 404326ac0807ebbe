"""Histogram decision trees in numpy: gradient boosting and random forests.

Training sets are bounded samples, so fitting runs on the driver; scoring is
vectorised and travels with the model (a few kilobytes).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


def _edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


@dataclass
class Tree:
    """Inner nodes go left where ``x[feature] <= threshold``; ``feature`` is -1 at leaves."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in zip((self.feature, self.threshold, self.left, self.right, self.value), (-1, 0.0, 0, 0, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            live = np.flatnonzero(f >= 0)
            if not len(live):
                return value[at]
            node = at[live]
            at[live] = np.where(x[live, f[live]] <= threshold[node], left[node], right[node])


def _grow(tree: Tree, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, min_weight: float, ridge: float, features, rng) -> None:
    """Grow by second-order gain; ``g`` and ``h`` are gradients and weights per row."""

    def leaf(rows: np.ndarray) -> float:
        return float(-g[rows].sum() / (h[rows].sum() + ridge))

    stack = [(tree.add(leaf(np.arange(len(g)))), np.arange(len(g)), 0)]
    while stack:
        node, rows, level = stack.pop()
        if level >= depth or len(rows) < 2:
            continue
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-9, -1, -1)
        chosen = range(bins.shape[1]) if features is None else rng.choice(bins.shape[1], features, replace=False)
        for j in chosen:
            if not len(edges[j]):
                continue
            b = bins[rows, j]
            cg = np.cumsum(np.bincount(b, g[rows], len(edges[j]) + 1))[:-1]
            ch = np.cumsum(np.bincount(b, h[rows], len(edges[j]) + 1))[:-1]
            gain = cg**2 / (ch + ridge) + (total_g - cg) ** 2 / (total_h - ch + ridge) - total_g**2 / (total_h + ridge)
            gain[(ch < min_weight) | (total_h - ch < min_weight)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(j), k)
        if best[1] < 0:
            continue
        _, j, k = best
        goes = bins[rows, j] <= k
        tree.feature[node], tree.threshold[node] = j, float(edges[j][k])
        for side, part in (("left", rows[goes]), ("right", rows[~goes])):
            child = tree.add(leaf(part))
            getattr(tree, side)[node] = child
            stack.append((child, part, level + 1))


@dataclass
class Boosted:
    """Logistic gradient boosting."""

    base: float
    rate: float
    trees: list[Tree]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, depth: int = 4, rate: float = 0.2, min_weight: float = 2.0, ridge: float = 1.0) -> Boosted:
        weight = np.ones(len(y)) if weight is None else weight
        p = np.clip(np.average(y, weights=weight) if len(y) else 0.5, 1e-3, 1 - 1e-3)
        base = float(np.log(p / (1 - p)))
        trees: list[Tree] = []
        if len(y) and 0 < y.mean() < 1:
            edges = _edges(x)
            bins = _binned(x, edges)
            score = np.full(len(y), base)
            for _ in range(rounds):
                q = 1 / (1 + np.exp(-score))
                tree = Tree()
                _grow(tree, bins, edges, weight * (q - y), weight * q * (1 - q), depth, min_weight, ridge, None, None)
                trees.append(tree)
                score += rate * tree.predict(x)
        return cls(base, rate, trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self.rate * tree.predict(x)
        return 1 / (1 + np.exp(-score))


@dataclass
class Forest:
    """Bagged trees with random features per split; predicts the mean of the leaves' shares."""

    trees: list[Tree]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, seed: int = 5) -> Forest:
        rng = np.random.default_rng(seed)
        edges = _edges(x)
        bins = _binned(x, edges)
        features = max(1, int(round(x.shape[1] ** 0.5)))
        made = []
        for _ in range(trees):
            weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
            rows = np.flatnonzero(weight)
            tree = Tree()
            # with g = -w*y and h = w a leaf holds the weighted mean of y, and gain is the drop in variance
            _grow(tree, bins[rows], edges, -weight[rows] * y[rows], weight[rows], depth, 1.0, 1e-9, features, rng)
            made.append(tree)
        return cls(made)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)
