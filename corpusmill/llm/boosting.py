"""Gradient-boosted trees of depth two over small integer features, their calibration on held-out folds, and
their form as a Spark expression."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf value, or (feature, threshold, below, from it on).
Tree = float | tuple[int, int, "Tree", "Tree"]


@dataclass
class Boosted:
    base: float
    trees: list[Tree]
    #: Least margin of a selected candidate by its kind; a kind that isn't there selects nothing.
    thresholds: dict[int, float] = field(default_factory=dict)
    #: By kind, what selected candidates of held-out folds came to: (precision, recall).
    held_out: dict[int, tuple[float, float]] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, values: list[Column]) -> Column:
        """The margin as one expression over the feature columns."""
        out = F.lit(self.base)
        for t in self.trees:
            out = out + _compile(t, values)
        return out


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, cut, low, high = tree
    return np.where(x[:, feature] < cut, _apply(low, x), _apply(high, x))


def _compile(tree: Tree, values: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, low, high = tree
    return F.when(values[feature] < cut, _compile(low, values)).otherwise(_compile(high, values))


def _grow(x, g, h, depth: int, ridge: float, rate: float) -> Tree:
    leaf = float(rate * g.sum() / (h.sum() + ridge))
    best, where = 1e-9, None
    total = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]) if depth else ():
        size = int(x[:, f].max()) + 1
        gs, hs = np.cumsum(np.bincount(x[:, f], g, size)), np.cumsum(np.bincount(x[:, f], h, size))
        for cut in range(1, size):
            gl, hl = gs[cut - 1], hs[cut - 1]
            gain = gl**2 / (hl + ridge) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + ridge) - total
            if gain > best:
                best, where = gain, (f, cut)
    if where is None:
        return leaf
    left = x[:, where[0]] < where[1]
    return (*where, _grow(x[left], g[left], h[left], depth - 1, ridge, rate), _grow(x[~left], g[~left], h[~left], depth - 1, ridge, rate))


def fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 40, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
    """Trees for feature rows x with counts of positive and negative examples."""
    n = positive + negative
    if not positive.sum() or not negative.sum():
        return Boosted(math.log((positive.sum() + 0.5) / (negative.sum() + 0.5)), [])
    model = Boosted(math.log(positive.sum() / negative.sum()), [])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-model.margin(x)))
        model.trees.append(_grow(x, positive - n * p, n * p * (1 - p), 2, ridge, rate))
    return model


def _held_out(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The margin of each row by trees that never saw its fold."""
    margin = np.zeros(len(x))
    for f in np.unique(fold):
        own = fold == f
        margin[own] = fit(x[~own], positive[~own], negative[~own]).margin(x[own])
    return margin


def calibrated(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, fold: np.ndarray, kind: np.ndarray, precision: float, spies: float = 0.05) -> Boosted:
    """Trees for feature rows with counts of positive and of unlabelled examples, some of which are positive too.

    A first model takes all unlabelled ones for negatives. Those that it scores, in folds it never saw, like the
    positives but their lowest share of spies are left out; the others are negatives that can be relied on, from which
    the trees are learnt anew. For each kind the threshold is the least from which on the share of positives among
    rows of held-out folds is at least precision."""
    margin, negative = _held_out(x, positive, unlabelled, fold), unlabelled.copy()
    kinds = np.unique(kind).tolist()
    for k in kinds:
        own = np.flatnonzero((kind == k) & (positive > 0))
        own = own[np.argsort(margin[own], kind="stable")]
        if len(own):
            place = np.searchsorted(np.cumsum(positive[own]), spies * positive[own].sum(), side="right")
            negative[(kind == k) & (margin >= margin[own[min(place, len(own) - 1)]])] = 0
    if not negative.sum():
        return Boosted(0.0, [])
    model, margin = fit(x, positive, negative), _held_out(x, positive, negative, fold)
    for k in kinds:
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-margin[own], kind="stable")]
        found, seen = np.cumsum(positive[own]), np.cumsum(positive[own] + negative[own])
        last = np.append(np.diff(margin[own]) != 0, True)  # a threshold takes equal margins together
        fine = np.flatnonzero(last & (found > 0) & (found >= precision * seen))
        if len(fine):
            at = fine[-1]
            model.thresholds[k] = float(margin[own][at])
            model.held_out[k] = (float(found[at] / seen[at]), float(found[at] / found[-1]))
    return model
