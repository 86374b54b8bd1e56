"""Trees as flat arrays: many deep trees are evaluated by array look-ups over Arrow batches instead of nested conditions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .cart import Node


@dataclass(frozen=True)
class Flat:
    """All nodes of all trees one after the other; a leaf is its own child. Children of a row: `left` where its value is at most the threshold, else `right`."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    values: np.ndarray
    depth: int

    @staticmethod
    def of(trees: list[Node], leaf) -> "Flat":
        """leaf(node) gives a node's numbers, of one length for all nodes."""
        feature, threshold, left, right, values, roots, deepest = [], [], [], [], [], [], 0
        for tree in trees:
            roots.append(len(feature))
            stack = [(tree, None, None, 0)]
            while stack:
                node, side, parent, depth = stack.pop()
                at, deepest = len(feature), max(deepest, depth)
                if parent is not None:
                    side[parent] = at
                feature.append(max(node.feature, 0))
                threshold.append(node.threshold)
                left.append(at)
                right.append(at)
                values.append(leaf(node))
                if not node.is_leaf:
                    stack += [(node.right, right, at, depth + 1), (node.left, left, at, depth + 1)]
        return Flat(*(np.array(x) for x in (roots, feature, threshold, left, right)), np.array(values, float), deepest)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree (rows by trees). A NaN goes right."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return at

    def sums(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """The trees' numbers added up, in the order of the trees (rows by numbers)."""
        out = np.zeros((len(x), self.values.shape[1]))
        for i in range(0, len(x), block):
            at = self.leaves(x[i : i + block])
            for t in range(len(self.roots)):
                out[i : i + block] += self.values[at[:, t]]
        return out

    def column(self, features: list[str]) -> Column:
        """Those sums as an array column. Null features count as NaN."""

        @F.pandas_udf("array<double>")
        def evaluate(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)
            return pd.Series(list(self.sums(x)))

        return evaluate(*[F.col(f"`{f}`").cast("double") for f in features])


#: Nodes of trees that are evaluated as nested conditions; more go through flat arrays.
EXPRESSION_NODES = 256


def value_of(trees: list[Node], features: list[str]) -> Column:
    """The trees' values added up."""
    if sum(1 for t in trees for _ in t.walk()) > EXPRESSION_NODES:
        return Flat.of(trees, lambda n: [n.value]).column(features)[0]
    parts = [t.column(features, lambda n: F.lit(float(n.value))) for t in trees]
    return parts[0] if len(parts) == 1 else F.aggregate(F.array(*parts), F.lit(0.0), lambda a, x: a + x)


def array_of(trees: list[Node], features: list[str], numbers) -> Column:
    """Arrays of the leaves' numbers, added up over the trees."""
    if sum(1 for t in trees for _ in t.walk()) > EXPRESSION_NODES:
        return Flat.of(trees, lambda n: list(numbers(n))).column(features)
    rows = [t.column(features, lambda n: F.array(*[F.lit(float(x)) for x in numbers(n)])) for t in trees]
    return rows[0] if len(rows) == 1 else F.aggregate(F.array(*rows[1:]), rows[0], lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
