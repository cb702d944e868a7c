"""A small gradient-boosted tree classifier that turns into a Column.

It is fitted on the driver on a bounded sample of labelled rows and scored by
built-in expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass(frozen=True)
class Boosted:
    features: tuple[str, ...]
    bias: float
    trees: tuple[Node, ...]

    def margin(self, features: dict[str, Column]) -> Column:
        """Log odds as one expression over feature columns."""

        def branch(node: Node) -> Column:
            if node.low is None:
                return F.lit(node.value)
            return F.when(features[self.features[node.feature]] <= F.lit(node.cut), branch(node.low)).otherwise(branch(node.high))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + branch(tree)
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            out += _apply(tree, x)
        return out


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.cut
    out = np.empty(len(x))
    out[low], out[~low] = _apply(node.low, x[low]), _apply(node.high, x[~low])
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, l2: float) -> Node:
    leaf = Node(value=float(rate * g.sum() / (h.sum() + l2)))
    if depth == 0 or len(x) < 16:
        return leaf
    base, best = g.sum() ** 2 / (h.sum() + l2), (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        ends = np.flatnonzero(v[1:] > v[:-1])
        if len(ends):
            gain = gs[ends] ** 2 / (hs[ends] + l2) + (gs[-1] - gs[ends]) ** 2 / (hs[-1] - hs[ends] + l2) - base
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Node(feature=best[1], cut=best[2], low=_grow(x[low], g[low], h[low], depth - 1, rate, l2), high=_grow(x[~low], g[~low], h[~low], depth - 1, rate, l2))


def fit(features: tuple[str, ...], x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Boosted:
    """Trees of second-order logistic boosting."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin, grown = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grown.append(_grow(x, y - p, p * (1 - p), depth, rate, l2))
        margin += _apply(grown[-1], x)
    return Boosted(features, bias, tuple(grown))


def calibrated_cut(margin: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest margin from which held-out rows reach a precision; halfway to the next lower margin."""
    order = np.argsort(-margin, kind="stable")
    ranked = margin[order]
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    # Rows of one margin are taken together.
    good = np.flatnonzero((right >= precision) & np.append(ranked[1:] < ranked[:-1], True))
    if not len(good):
        return float("inf")
    last = int(good[-1])
    return float((ranked[last] + ranked[min(last + 1, len(ranked) - 1)]) / 2)
