"""Gradient-boosted trees for a small labelled table: fitted by numpy on the driver, scored as a Spark column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Node = tuple[int, float, object, object] | float


@dataclass
class Trees:
    base: float
    trees: list[Node]

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The probability, as nested CASE expressions over the features' columns."""

        def branch(node: Node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, cut, low, high = node
            return F.when(feature(at) <= cut, branch(low)).otherwise(branch(high))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + branch(t)
        return 1 / (1 + F.exp(-total))

    def told(self) -> list:
        """What of() makes the trees of again: lists and numbers."""
        return [self.base, self.trees]

    @staticmethod
    def of(told: list) -> Trees:
        def node(x) -> Node:
            return (int(x[0]), float(x[1]), node(x[2]), node(x[3])) if isinstance(x, list) else float(x)

        return Trees(float(told[0]), [node(t) for t in told[1]])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(_apply(t, x) for t in self.trees))))


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    at, cut, low, high = node
    return np.where(x[:, at] <= cut, _apply(low, x), _apply(high, x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float, least: int) -> Node:
    """A regression tree on gradients and curvatures, by the best split over all cuts of all features."""
    best: tuple[float, int, float] | None = None
    score = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1] if depth and len(x) >= 2 * least else 0):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        cuts = cuts[(cuts + 1 >= least) & (len(x) - cuts - 1 >= least)]
        if not len(cuts):
            continue
        gain = gs[cuts] ** 2 / (hs[cuts] + ridge) + (gs[-1] - gs[cuts]) ** 2 / (hs[-1] - hs[cuts] + ridge) - score
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    if best is None:
        return float(rate * -g.sum() / (h.sum() + ridge))
    _, f, cut = best
    low = x[:, f] <= cut
    grown = [_grow(x[own], g[own], h[own], depth - 1, rate, ridge, least) for own in (low, ~low)]
    return f, cut, grown[0], grown[1]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 4) -> Trees:
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    out = Trees(float(np.log(share / (1 - share))), [])
    z = np.full(len(x), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, p - y, p * (1 - p), depth, rate, ridge, least)
        out.trees.append(tree)
        z = z + _apply(tree, x)
    return out
