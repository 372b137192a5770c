"""Gradient-boosted trees in numpy: histogram training, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees in one set of arrays; a leaf has feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Log odds: every row walks all trees level by level, one gather per level."""
        total = np.full(len(rows), self.base)
        index = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                feature = self.feature[node]
                goes_left = rows[index, np.maximum(feature, 0)] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(rows), -40, 40)))


def fit_trees(
    rows: np.ndarray, target: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 64, least: int = 8, ridge: float = 1.0,
) -> Trees:
    """Boost logistic loss. ``monotone`` holds +1, -1 or 0 per feature: the score never falls, never rises, is free.

    A split on a constrained feature is only allowed with its two values in order, and the middle of the two bounds
    all values below it, so no later split can undo the order.
    """
    count, width = rows.shape
    if not count:
        return Trees(*[np.array([x]) for x in (-1, 0.0, 0, 0, 0.0, 0)], base=0.0, depth=1)
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], rows[:, j], side="left") for j in range(width)], axis=1)
    mean = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(count, base)
    nodes: list[list[float]] = []
    roots: list[int] = []

    def grow(members: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, low: float, high: float, level: int) -> int:
        own = len(nodes)
        g, h = gradient[members].sum(), hessian[members].sum()
        nodes.append([-1, 0.0, own, own, float(np.clip(-g / (h + ridge), low, high)) * rate])
        if level == depth or len(members) < 2 * least:
            margin[members] += nodes[own][4]
            return own
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(width):
            size = len(edges[j]) + 1
            if size < 2:
                continue
            of = binned[members, j]
            gs = np.bincount(of, gradient[members], size).cumsum()[:-1]
            hs = np.bincount(of, hessian[members], size).cumsum()[:-1]
            ns = np.bincount(of, minlength=size).cumsum()[:-1]
            left, right = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)

            def worth(a, b, value):
                return -(a * value + 0.5 * (b + ridge) * value * value)

            gain = worth(gs, hs, left) + worth(g - gs, h - hs, right) - worth(g, h, nodes[own][4] / rate)
            allowed = (ns >= least) & (len(members) - ns >= least) & ((right - left) * monotone[j] >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(left[k]), float(right[k]))
        _, j, k, left, right = best
        if j < 0:
            margin[members] += nodes[own][4]
            return own
        goes_left = binned[members, j] <= k
        middle = (left + right) / 2
        left_bounds = {0: (low, high), 1: (low, middle), -1: (middle, high)}[int(monotone[j])]
        right_bounds = {0: (low, high), 1: (middle, high), -1: (low, middle)}[int(monotone[j])]
        a = grow(members[goes_left], gradient, hessian, *left_bounds, level + 1)
        b = grow(members[~goes_left], gradient, hessian, *right_bounds, level + 1)
        nodes[own][:4] = [j, float(edges[j][k]), a, b]
        return own

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        roots.append(grow(np.arange(count), p - target, np.maximum(p * (1 - p), 1e-6), -4.0, 4.0, 0))
    table = np.array(nodes)
    whole = [table[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Trees(whole[0], table[:, 1], whole[1], whole[2], table[:, 4], np.array(roots), base, depth)
