"""Boosted trees over binned features: one pass turns values to bytes, a level of a tree is one aggregation of histograms.

The binned rows are written once and carry the score of the trees so far, which is brought up to date every `REFRESH`
trees. Between, a row's score and its node are computed from its bytes and the trees grown since, so no level and no tree
rewrites the rows. Histograms are summed in tasks, then by cell; only the smaller child of a split is counted, its sibling is the
parent less it. What the driver holds is histograms: nodes of a level by features by bins, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Config, EmptyInputError, InvalidParameterError, require
from ..plans.cart import Node
from ..plans.flat import Flat, value_of
from ..plans.frame import number, order_statistics
from ..plans.scratch import discard, materialize
from . import metrics

#: Trees between two rewrites of the scores, the byte of a missing value, and the largest number of histogram cells of a level.
REFRESH, MISSING, CELLS = 8, 255, 1 << 25


@dataclass(frozen=True)
class Bins:
    """Upper ends of the bins of every feature, ascending; a value's bin is the number of ends below it."""

    ends: tuple[tuple[float, ...], ...]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows of bytes; NaN is MISSING."""
        out = np.empty(x.shape, np.uint8)
        for j, ends in enumerate(self.ends):
            out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(ends, x[:, j], side="left"))
        return out


def bins_of(df: DataFrame, columns: list[Column], most: int) -> Bins:
    """Ends at the exact order statistics of rank ceil(n q / most); values that are equal share a bin."""
    found = order_statistics(df, [F.when(~F.isnan(c), c) for c in columns], lambda n: [ceil(n * q / most) for q in range(1, most)])
    return Bins(tuple(tuple(sorted(set(x.values()))) for x in found))


SQUARED, LOG = "squared_error", "log_loss"


def _gradients(loss: str, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == SQUARED:
        return raw - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-raw))
    return p - y, p * (1 - p)


def _numbered_tree(root: Node, places: dict[int, int]) -> Node:
    """A copy whose leaves have as value the place of the open node there, or -1."""
    if root.is_leaf:
        return replace(root, value=float(places.get(id(root), -1)))
    return replace(root, left=_numbered_tree(root.left, places), right=_numbered_tree(root.right, places))


def _flat_bytes(trees: list[Node]) -> Flat | None:
    return Flat.of(trees, lambda n: [n.value]) if trees else None


@dataclass(frozen=True)
class HistGradientBoosting(Config):
    """loss: `squared_error`, or `log_loss` for labels of two classes. Missing values (null or NaN) go right at every split."""

    loss: str = SQUARED
    learning_rate: float = 0.1
    max_iter: int = 100
    max_depth: int = 6
    min_samples_leaf: int = 20
    l2_regularization: float = 0.0
    max_bins: int = 255

    def _valid(self, p: int) -> None:
        if self.loss not in (SQUARED, LOG):
            raise InvalidParameterError(f"unknown loss {self.loss}")
        if self.learning_rate <= 0 or self.max_iter < 1 or self.max_depth < 1 or self.min_samples_leaf < 1 or self.l2_regularization < 0 or not 2 <= self.max_bins <= 255:
            raise InvalidParameterError("learning_rate > 0, max_iter, max_depth and min_samples_leaf >= 1, l2_regularization >= 0 and 2 <= max_bins <= 255 are needed")
        if 2**self.max_depth * p * self.max_bins * 3 > CELLS:
            raise InvalidParameterError("a level's histograms are too many for the driver: fewer bins, features or levels are needed")

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> "HistBoostedModel":
        """Labels may not be missing. The trees do not depend on how rows are dealt out, but for the rounding of sums."""
        require(df, [*features, label])
        self._valid(len(features))
        x, y = [number(f) for f in features], number(label)
        classes: tuple[float, ...] = ()
        n, low, high, mean, bad = df.agg(F.count("*"), F.min(y), F.max(y), F.avg(y), F.sum((y.isNull() | F.isnan(y)).cast("long"))).first()
        if not n:
            raise EmptyInputError("no rows")
        if bad:
            raise InvalidParameterError(f"{bad} null or NaN labels")
        start = mean
        if self.loss == LOG:
            others, share = df.agg(F.sum(((y != low) & (y != high)).cast("long")), F.avg((y == high).cast("double"))).first()
            if others or low == high:
                raise InvalidParameterError("exactly two classes are needed")
            classes, start = (low, high), log(share / (1 - share))
            y = (y == high).cast("double")
        bins = bins_of(df, x, self.max_bins)
        rows = self._binned(df, x, y, bins, start)
        trees: list[Node] = []
        held: list[Node] = []  # trees that the rows' scores don't hold yet
        for t in range(self.max_iter):
            tree = self._grow(rows, held, len(features))
            trees.append(tree)
            held.append(tree)
            if tree.is_leaf and tree.value == 0.0:
                break
            if len(held) == REFRESH and t + 1 < self.max_iter:
                old, rows, held = rows, materialize(self._scored(rows, held), "binned"), []
                discard(old)
        discard(rows)
        return HistBoostedModel(tuple(features), classes, tuple(_valued(t, bins) for t in trees), start)

    def _binned(self, df: DataFrame, x: list[Column], y: Column, bins: Bins, start: float) -> DataFrame:
        """Rows (b, y, raw): the features' bytes, the label, the score. Written."""
        p = len(x)

        def code(batches):
            for batch in batches:
                values = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(p)], axis=1)
                codes = bins.codes(values)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(p), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([packed, batch.column(p), pa.array(np.full(len(codes), start))], names=["b", "y", "raw"])

        return materialize(df.select(*[c.alias(f"x{j}") for j, c in enumerate(x)], y.alias("y")).mapInArrow(code, "b binary, y double, raw double"), "binned")

    def _scored(self, rows: DataFrame, held: list[Node]) -> DataFrame:
        flat = _flat_bytes(held)

        def score(batches):
            for b in batches:
                raw = b.column("raw").to_numpy() + flat.sums(_bytes(b))[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("b"), b.column("y"), pa.array(raw)], names=["b", "y", "raw"])

        return rows.mapInArrow(score, "b binary, y double, raw double")

    def _grow(self, rows: DataFrame, held: list[Node], p: int) -> Node:
        """One tree; thresholds are bytes."""
        root = Node(0.0, 0.0)
        hist = self._histograms(rows, held, root, [root], p)[0]
        self._value(root, hist)
        open_nodes = [(root, hist)]
        for depth in range(self.max_depth):
            split, small = [], []
            for node, hist in open_nodes:
                best = self._best(hist)
                if best is None:
                    continue
                node.gain, node.feature, node.threshold, left = best
                node.left, node.right = Node(left[2], 0.0), Node(node.n - left[2], 0.0)
                first = node.left.n <= node.right.n
                split.append((node, hist, first))
                small.append(node.left if first else node.right)
            if not split:
                break
            if depth + 1 == self.max_depth:
                for node, hist, _ in split:  # the last level's sums follow from its parent's histogram
                    cut = hist[node.feature, : int(node.threshold) + 1].sum(0)
                    self._value(node.left, cut[None, None, :])
                    self._value(node.right, (hist[node.feature].sum(0) - cut)[None, None, :])
                break
            counted = self._histograms(rows, held, root, small, p)
            open_nodes = []
            for (node, hist, first), mine in zip(split, counted):
                other = hist - mine
                for child, h in ((node.left, mine if first else other), (node.right, other if first else mine)):
                    self._value(child, h)
                    open_nodes.append((child, h))
        return root

    def _value(self, node: Node, hist: np.ndarray) -> None:
        g, h, n = hist[0].sum(0)
        node.n = float(round(n))
        node.value = 0.0 if h + self.l2_regularization <= 0 else -self.learning_rate * g / (h + self.l2_regularization)

    def _best(self, hist: np.ndarray):
        """The split of largest gain, compared to nine digits: then the first feature, the lowest bin."""
        left = np.cumsum(hist, axis=1)
        total = left[:, -1:, :]
        right = total - left
        part = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + self.l2_regularization, 1e-300)
        gain = np.round(part(left) + part(right) - part(total), 9)
        able = (np.round(left[..., 2]) >= self.min_samples_leaf) & (np.round(right[..., 2]) >= self.min_samples_leaf)
        gain = np.where(able, gain, 0.0)
        at = int(gain.argmax())
        f, b = divmod(at, gain.shape[1])
        return (float(gain[f, b]), f, float(b), left[f, b]) if gain[f, b] > 0 else None

    def _histograms(self, rows: DataFrame, held: list[Node], root: Node, wanted: list[Node], p: int) -> list[np.ndarray]:
        """Of these leaves of the tree so far: one aggregation over the binned rows."""
        before = _flat_bytes(held)
        place = _flat_bytes([_numbered_tree(root, {id(n): i for i, n in enumerate(wanted)})])
        loss, slots = self.loss, len(wanted)

        def count(batches):
            total = np.zeros((3, slots * p * 256))
            shift = np.arange(p) * 256
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, raw = _bytes(b), b.column("y").to_numpy(), b.column("raw").to_numpy()
                slot = place.sums(x)[:, 0].astype(np.int64)
                inside = slot >= 0
                if not inside.any():
                    continue
                x, y, raw, slot = x[inside], y[inside], raw[inside], slot[inside]
                g, h = _gradients(loss, y, raw + before.sums(x)[:, 0] if before else raw)
                cell = (slot[:, None] * (p * 256) + shift[None, :] + x).reshape(-1)
                for i, w in enumerate((g, h, np.ones(len(g)))):
                    total[i] += np.bincount(cell, weights=np.repeat(w, p), minlength=total.shape[1])
            used = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(t[used]) for t in total]], names=["cell", "g", "h", "n"])

        sums = rows.mapInArrow(count, "cell bigint, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        out = np.zeros((slots * p * 256, 3))
        for i, c in enumerate("ghn"):
            out[sums.column("cell").to_numpy(), i] = sums.column(c).to_numpy()
        return list(out.reshape(slots, p, 256, 3))


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    """The rows' bytes as a matrix of numbers: all values have one length, so the data buffer is the matrix."""
    b = batch.column(0)
    _, offsets, data = b.buffers()
    ends = np.frombuffer(offsets, np.int32 if b.type == pa.binary() else np.int64)[b.offset : b.offset + len(b) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(len(b), -1).astype(np.int64)


def _valued(node: Node, bins: Bins) -> Node:
    """The tree over values: a threshold is the upper end of its last bin on the left. Only missing values lie above the last bin."""
    if node.is_leaf:
        return node
    ends = bins.ends[node.feature]
    at = int(node.threshold)
    return replace(node, threshold=ends[at] if at < len(ends) else float("inf"), left=_valued(node.left, bins), right=_valued(node.right, bins))


@dataclass(frozen=True)
class HistBoostedModel:
    features: tuple[str, ...]
    classes: tuple[float, ...]
    trees: tuple[Node, ...]
    start: float

    @property
    def feature_importances(self) -> tuple[float, ...]:
        """Gains by feature over all splits, summing to 1 if any."""
        total = [0.0] * len(self.features)
        for node in (n for t in self.trees for n in t.walk() if not n.is_leaf):
            total[node.feature] += node.gain
        return tuple(x / sum(total) if sum(total) else 0.0 for x in total)

    def raw(self) -> Column:
        """The score: one expression for a few small trees, look-ups in flat arrays for more."""
        return F.lit(self.start) + value_of(list(self.trees), list(self.features))

    def column(self) -> Column:
        """The prediction, or the probability of the second class."""
        return 1.0 / (1.0 + F.exp(-self.raw())) if self.classes else self.raw()

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, F.when(self.column() >= 0.5, self.classes[1]).otherwise(self.classes[0]) if self.classes else self.column())

    def predict_probabilities(self, df: DataFrame, output: str = "probability") -> DataFrame:
        require(df, self.features)
        if not self.classes:
            raise InvalidParameterError("only a model of two classes has probabilities")
        return df.withColumn("_p1", self.column()).withColumn(output, F.array(1.0 - F.col("_p1"), F.col("_p1"))).drop("_p1")

    def score(self, df: DataFrame, label: str = "label") -> float:
        return (metrics.accuracy if self.classes else metrics.r2)(self.predict(df, "_p"), label, "_p")
