"""Gradient-boosted trees over small categorical features, with SQL for scoring.

The trees are fitted to a table of counts: one row for each combination of feature codes that occurs,
with its numbers of positive and negative rows. Codes are small, so the table is bounded by the
product of their ranges whatever the size of the data, and every row of the data counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Cell:
    codes: tuple[int, ...]
    positive: float
    negative: float


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: int
    most: int  # codes up to this go left
    left: Split | Leaf
    right: Split | Leaf


def _leaf(rows: list[tuple[Cell, float]], shrink: float) -> Leaf:
    gradient = sum(c.positive - (c.positive + c.negative) * p for c, p in rows)
    curve = sum((c.positive + c.negative) * p * (1 - p) for c, p in rows)
    return Leaf(shrink * gradient / (curve + 1.0))


def _gain(rows: list[tuple[Cell, float]]) -> float:
    gradient = sum(c.positive - (c.positive + c.negative) * p for c, p in rows)
    return gradient * gradient / (sum((c.positive + c.negative) * p * (1 - p) for c, p in rows) + 1.0)


def _grow(rows: list[tuple[Cell, float]], depth: int, shrink: float) -> Split | Leaf:
    best, whole = None, _gain(rows)
    for f in range(len(rows[0][0].codes)) if depth and rows else ():
        for most in sorted({c.codes[f] for c, _ in rows})[:-1]:
            left = [r for r in rows if r[0].codes[f] <= most]
            right = [r for r in rows if r[0].codes[f] > most]
            gain = _gain(left) + _gain(right) - whole
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = gain, f, most, left, right
    if best is None:
        return _leaf(rows, shrink)
    _, f, most, left, right = best
    return Split(f, most, _grow(left, depth - 1, shrink), _grow(right, depth - 1, shrink))


def _value(tree: Split | Leaf, codes: Sequence[int]) -> float:
    while isinstance(tree, Split):
        tree = tree.left if codes[tree.feature] <= tree.most else tree.right
    return tree.value


def _column(tree: Split | Leaf, codes: Sequence[Column]) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(codes[tree.feature] <= tree.most, _column(tree.left, codes)).otherwise(_column(tree.right, codes))


@dataclass
class Boosted:
    base: float
    trees: list[Split | Leaf]

    def logit(self, codes: Sequence[int]) -> float:
        out = self.base
        for t in self.trees:  # added in the order of ``column``, so both give the same double
            out += _value(t, codes)
        return out

    def column(self, codes: Sequence[Column]) -> Column:
        """The logit of a row."""
        out = F.lit(self.base)
        for t in self.trees:
            out = out + _column(t, codes)
        return out


def fit(cells: list[Cell], rounds: int = 20, depth: int = 2, shrink: float = 0.3) -> Boosted:
    """Logistic boosting; without cells the model says one half."""
    positive, negative = sum(c.positive for c in cells), sum(c.negative for c in cells)
    model = Boosted(math.log((positive + 1.0) / (negative + 1.0)), [])
    logits = [model.base] * len(cells)
    for _ in range(rounds if cells else 0):
        rows = [(c, 1 / (1 + math.exp(-x))) for c, x in zip(cells, logits)]
        tree = _grow(rows, depth, shrink)
        model.trees.append(tree)
        logits = [x + _value(tree, c.codes) for c, x in zip(cells, logits)]
    return model
