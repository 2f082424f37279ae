"""Gradient-boosted depth-two trees over small integer features, fitted to counts and applied as SQL.

The counts are a table with one row for each combination of feature values, so
what reaches the driver is bounded by the number of combinations, not by rows.
"""

from __future__ import annotations

import numpy as np


def fit(features: np.ndarray, positives: np.ndarray, totals: np.ndarray, *, rounds: int = 24, rate: float = 0.4, shrink: float = 1.0) -> tuple[float, list]:
    """Logistic boosting; features is (rows, columns) of small integers. Returns the bias and the trees.

    A tree is (column, limit, left, right), going left where value <= limit; a leaf is a float.
    """
    prior = (positives.sum() + 1) / (totals.sum() + 2)
    bias = float(np.log(prior / (1 - prior)))
    score = np.full(len(totals), bias)
    splits = [(c, v) for c in range(features.shape[1]) for v in np.unique(features[:, c])[:-1]]
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = positives - totals * p, totals * p * (1 - p)
        tree = _grow(features, gradient, weight, splits, 2, rate, shrink)
        trees.append(tree)
        score += np.array([value(tree, row) for row in features]) if len(features) else 0
    return bias, trees


def _grow(x, gradient, weight, splits, depth, rate, shrink):
    def gain(mask):
        return gradient[mask].sum() ** 2 / (weight[mask].sum() + shrink)

    if depth and splits and len(x):
        column, limit = max(splits, key=lambda s: gain(x[:, s[0]] <= s[1]) + gain(x[:, s[0]] > s[1]))
        left = x[:, column] <= limit
        if left.any() and not left.all():
            grown = [_grow(x[m], gradient[m], weight[m], splits, depth - 1, rate, shrink) for m in (left, ~left)]
            return int(column), int(limit), grown[0], grown[1]
    return float(rate * gradient.sum() / (weight.sum() + shrink))


def value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def probability(bias: float, trees: list, row) -> float:
    return float(1 / (1 + np.exp(-(bias + sum(value(t, row) for t in trees)))))


def sql(bias: float, trees: list, names: list[str]) -> str:
    """The probability as a SQL expression over the named features."""

    def one(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D" if "e" not in repr(tree) else f"{tree:.12f}D"
        return f"IF({names[tree[0]]} <= {tree[1]}, {one(tree[2])}, {one(tree[3])})"

    return f"1D / (1D + exp(-({bias:.12f}D + {' + '.join(map(one, trees)) or '0D'})))"


def threshold(scores: np.ndarray, positives: np.ndarray, totals: np.ndarray, precision: float) -> float:
    """The lowest score from which upward the share of positives is ``precision`` at least; above 1 if none is."""
    order = np.argsort(-scores, kind="stable")
    share = np.cumsum(positives[order]) / np.maximum(np.cumsum(totals[order]), 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True)  # equal scores stand or fall together
    good = np.flatnonzero((share >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else 2.0
