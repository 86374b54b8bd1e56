"""Exact CART: nodes with many rows are split one level at a time, all nodes of all trees together; smaller ones are finished in tasks.

Rows are (tree, node, w, y, features). Each level is one plan of aggregations and windows. Values of a feature are counted per node before anything else, so repeated values
cost nothing further. Running sums over a feature's values go in two steps, inside ranges of values and over the ranges,
so no task holds all distinct values of a feature. A node of at most `SMALL` rows goes with its rows to one task, which grows all that is below it
by the same rules; so depth costs no jobs, and a node's number is given, not doubled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: Ranges of values within a feature, and rows up to which one task finishes a node.
RANGES, SMALL = 64, 1 << 16


@dataclass
class Node:
    """A leaf where feature is -1. value: mean of the labels, or the most frequent class; counts by class for classification."""

    n: float
    value: float
    proba: tuple[float, ...] = ()
    impurity: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    gain: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None

    @property
    def is_leaf(self) -> bool:
        return self.feature == -1

    def depth(self) -> int:
        deepest, stack = 0, [(self, 0)]
        while stack:
            node, at = stack.pop()
            deepest = max(deepest, at)
            if not node.is_leaf:
                stack += [(node.right, at + 1), (node.left, at + 1)]
        return deepest

    def walk(self):
        """All nodes, a node before its children, the left before the right."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if not node.is_leaf:
                stack += [node.right, node.left]

    def column(self, features: list[str], leaf) -> Column:
        """Nested conditions; leaf(node) gives a leaf's value. A null or NaN value goes right."""
        if self.is_leaf:
            return leaf(self)
        x = F.col(f"`{features[self.feature]}`").cast("double")
        return F.when((x <= self.threshold) & ~F.isnan(x), self.left.column(features, leaf)).otherwise(self.right.column(features, leaf))


@dataclass(frozen=True)
class Params:
    max_depth: int = -1
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    criterion: str = "gini"
    classes: tuple[float, ...] = field(default=())  # empty: regression


def _impurity(sums: list[Column], n: Column, p: Params) -> Column:
    """Of weighted class counts, or of sums of y and y squared."""
    if not p.classes:
        return F.greatest(sums[1] / n - (sums[0] / n) * (sums[0] / n), F.lit(0.0))
    shares = [s / n for s in sums]
    if p.criterion == "gini":
        return F.lit(1.0) - sum((s * s for s in shares), F.lit(0.0))
    return -sum((F.when(s > 0, s * F.log2(s)).otherwise(0.0) for s in shares), F.lit(0.0))


def grow(rows: DataFrame, features: list[str], p: Params, allowed: dict[int, list[int]] | None = None) -> dict[int, Node]:
    """Trees by number. rows: tree, w (a count), y (class number, or label), and the features as columns.

    allowed: the features of each tree (all if missing). Gains are compared to 12 digits, then the earliest feature and the
    lowest threshold win. Classification takes splits without a gain, regression does not.
    """
    k = len(p.classes)
    weights = [F.col("w") * (F.col("y") == c).cast("double") for c in range(k)] if k else [F.col("w") * F.col("y"), F.col("w") * F.col("y") * F.col("y")]
    names = [f"s{i}" for i in range(len(weights))]
    keys = ["tree", "node"]
    data = materialize(rows.withColumn("node", F.lit(1).cast("long")), "cart")
    bounds = None
    trees: dict[int, Node] = {}
    parents: dict[int, tuple[Node, str]] = {}
    depth, last = 0, 1
    small: list[DataFrame] = []  # levels' rows of nodes that tasks finish
    while True:
        sizes = data.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > SMALL).select("tree", "node", "rows").collect()  # a row a large node
        large = data.sparkSession.createDataFrame([(r.tree, r.node) for r in sizes], "tree int, node long")
        few = data.join(F.broadcast(large), keys, "left_anti") if sizes else data
        finished = _finish(few, features, p, allowed, depth)
        for (tree, node), root in finished.items():
            _attach(trees, parents, tree, node, root)
        if not sizes:
            discard(data)
            return trees
        rest = data.join(F.broadcast(large), keys, "left_semi")
        bounds = bounds or _ranges(data, features)
        stats = rest.groupBy(*keys).agg(F.sum("w").alias("n"), *[F.sum(e).alias(s) for e, s in zip(weights, names)], F.min("y").alias("lo"), F.max("y").alias("hi")).collect()
        at, split_ids = {}, []
        for r in stats:
            sums = [r[s] for s in names]
            if k:
                proba = tuple(s / r.n for s in sums)
                node = Node(r.n, p.classes[max(range(k), key=lambda c: (sums[c], -c))], proba)
            else:
                node = Node(r.n, sums[0] / r.n)
            _attach(trees, parents, r.tree, r.node, node)
            at[r.tree, r.node] = node
            if r.lo != r.hi and r.n >= p.min_samples_split and not 0 <= p.max_depth <= depth:
                split_ids.append((r.tree, r.node, 0.0 if k else node.value))
        best = _splits(rest, features, bounds, names, weights, p, allowed, {r.tree: None for r in stats}, split_ids) if split_ids else []
        if not best:
            discard(data)
            return trees
        moves = []
        for r in best:
            node = at[r.tree, r.node]
            node.feature, node.threshold, node.gain = r.feature, r.threshold, r.gain
            parents[last + 1], parents[last + 2] = (node, "left"), (node, "right")
            moves.append((r.tree, r.node, r.feature, r.threshold, last + 1, last + 2))
            last += 2
        table = rows.sparkSession.createDataFrame(moves, "tree int, node long, feature int, threshold double, l long, r long")
        x = F.get(F.array(*[F.col(f"`{f}`") for f in features]), F.col("feature"))
        moved = rest.join(table, keys).withColumn("node", F.when(x <= F.col("threshold"), F.col("l")).otherwise(F.col("r"))).drop("feature", "threshold", "l", "r")
        old, data = data, materialize(moved, "cart")
        discard(old)
        depth += 1


def _attach(trees: dict[int, Node], parents: dict[int, tuple[Node, str]], tree: int, number: int, node: Node) -> None:
    if number == 1:
        trees[tree] = node
    else:
        parent, side = parents.pop(number)
        setattr(parent, side, node)


def _ranges(data: DataFrame, features: list[str]) -> list[list[float]]:
    got = data.select(*[F.percentile_approx(F.when(~F.isnan(F.col(f"`{f}`")), F.col(f"`{f}`")), [i / RANGES for i in range(1, RANGES)], 2000) for f in features]).first()
    return [sorted(set(b or [])) for b in got]


def _finish(rows: DataFrame, features: list[str], p: Params, allowed, depth: int) -> dict[tuple[int, int], Node]:
    """The subtrees of all nodes of `rows`: a task gets a node's rows, at most SMALL of them. What returns is nodes, not rows."""
    kind = "tree int, root long, at int, feature int, threshold double, gain double, n double, value double, proba array<double>, left int, right int"

    def grow_here(table: pa.Table) -> pa.Table:
        tree, root = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        x = np.stack([table.column(f"x{j}").to_numpy() for j in range(len(features))], axis=1)
        nodes = _local(x, table.column("y").to_numpy(), table.column("w").to_numpy(), p, allowed[tree] if allowed is not None else range(len(features)), depth)
        return pa.Table.from_pylist([{"tree": tree, "root": root, "at": i, **n} for i, n in enumerate(nodes)], pa.schema([("tree", pa.int32()), ("root", pa.int64()), ("at", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()), ("gain", pa.float64()), ("n", pa.float64()), ("value", pa.float64()), ("proba", pa.list_(pa.float64())), ("left", pa.int32()), ("right", pa.int32())]))

    d = rows.select("tree", "node", "w", "y", *[F.col(f"`{f}`").alias(f"x{j}") for j, f in enumerate(features)])
    made: dict[tuple[int, int], dict[int, tuple[Node, int, int]]] = {}
    for r in d.groupBy("tree", "node").applyInArrow(grow_here, kind).collect():
        made.setdefault((r.tree, r.root), {})[r.at] = Node(r.n, r.value, tuple(r.proba), 0.0, r.feature, r.threshold, r.gain), r.left, r.right
    for nodes in made.values():
        for node, left, right in nodes.values():
            if not node.is_leaf:
                node.left, node.right = nodes[left][0], nodes[right][0]
    return {key: nodes[0][0] for key, nodes in made.items()}


def _local(x: np.ndarray, y: np.ndarray, w: np.ndarray, p: Params, features, depth: int) -> list[dict]:
    """All nodes below some rows, the first is their own; the same splits as `_splits` finds."""
    k = len(p.classes)
    out: list[dict] = []
    stack = [(np.arange(len(y)), depth, None, "")]
    while stack:
        rows, level, parent, side = stack.pop()
        if parent is not None:
            out[parent][side] = len(out)
        yy, ww = y[rows], w[rows]
        n = float(ww.sum())
        node = {"feature": -1, "threshold": 0.0, "gain": 0.0, "n": n, "proba": [], "left": -1, "right": -1}
        if k:
            sums = np.bincount(yy.astype(int), weights=ww, minlength=k)
            node["value"], node["proba"] = float(p.classes[int(sums.argmax())]), (sums / n).tolist()
        else:
            node["value"] = float((ww * yy).sum() / n)
        out.append(node)
        if yy.min() == yy.max() or n < p.min_samples_split or 0 <= p.max_depth <= level:
            continue
        best = None
        for f in features:
            found = _cut(x[rows, f], yy, ww, p)
            if found is not None and (best is None or found[0] > best[0]):
                best = (*found, f)
        if best is None or not k and best[0] <= 0:
            continue
        node["gain"], node["threshold"], node["feature"] = float(best[0]), float(best[1]), int(best[2])
        here = len(out) - 1
        with np.errstate(invalid="ignore"):
            below = x[rows, best[2]] <= best[1]
        stack += [(rows[~below], level + 1, here, "right"), (rows[below], level + 1, here, "left")]
    return out


def _cut(v: np.ndarray, y: np.ndarray, w: np.ndarray, p: Params) -> tuple[float, float] | None:
    """Gain (12 digits) and threshold of a feature's best split, the lowest of equals. NaN is larger than all values."""
    order = np.argsort(v, kind="stable")
    v, y, w = v[order], y[order], w[order]
    last = np.flatnonzero(~((v[:-1] == v[1:]) | (np.isnan(v[:-1]) & np.isnan(v[1:]))))  # a value's last row
    if not len(last):
        return None
    if p.classes:
        each = w[:, None] * (y[:, None] == np.arange(len(p.classes)))
    else:
        y = y - (w * y).sum() / w.sum()  # about the node's mean
        each = np.stack([w * y, w * y * y], axis=1)
    upto, ln = np.cumsum(each, axis=0), np.cumsum(w)
    total, n = upto[-1], ln[-1]
    left, ln = upto[last], ln[last]
    rn = n - ln
    able = (ln >= p.min_samples_leaf) & (rn >= p.min_samples_leaf)
    if not able.any():
        return None
    gain = np.round(_plain_impurity(total[None], np.array([n]), p) - ln / n * _plain_impurity(left, ln, p) - rn / n * _plain_impurity(total - left, np.maximum(rn, 1e-300), p), 12)
    at = int(np.where(able, gain, -np.inf).argmax())
    low, high = v[last[at]], v[last[at] + 1]
    return float(gain[at]), float(low if np.isnan(high) else (low + high) / 2)


def _plain_impurity(sums: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    if not p.classes:
        return np.maximum(sums[:, 1] / n - (sums[:, 0] / n) ** 2, 0.0)
    shares = sums / n[:, None]
    if p.criterion == "gini":
        return 1.0 - (shares * shares).sum(1)
    return -np.where(shares > 0, shares * np.log2(np.where(shares > 0, shares, 1.0)), 0.0).sum(1)


def _splits(data, features, bounds, names, weights, p: Params, allowed, tree_ids, split_ids) -> list:
    spark = data.sparkSession
    live = spark.createDataFrame(split_ids, "tree int, node long, mean double")  # labels are centred by node, so squares don't cancel
    d = data.join(F.broadcast(live), ["tree", "node"]).withColumn("y", F.col("y") - F.col("mean")).drop("mean")
    keys, cell = ["tree", "node", "f"], ["tree", "node", "f", "b"]
    d = d.select("tree", "node", "w", "y", F.posexplode(F.array(*[F.col(f"`{f}`") for f in features])).alias("f", "v"))
    if allowed is not None:
        d = d.join(F.broadcast(spark.createDataFrame([(t, f) for t in tree_ids for f in allowed[t]], "tree int, f int")), ["tree", "f"], "left_semi")
    hist = d.groupBy("tree", "node", "f", "v").agg(F.sum("w").alias("n"), *[F.sum(e).alias(s) for e, s in zip(weights, names)])
    table = F.array(*[F.array(*[F.lit(float(x)) for x in b]) if b else F.array().cast("array<double>") for b in bounds])
    hist = hist.withColumn("b", F.size(F.filter(F.get(table, F.col("f")), lambda x: x < F.col("v"))))
    part = hist.groupBy(*cell).agg(F.sum("n").alias("bn"), F.min("v").alias("first"), *[F.sum(s).alias(f"b{s}") for s in names])
    over, whole = Window.partitionBy(*keys).orderBy("b"), Window.partitionBy(*keys)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    part = part.select(*cell, zero(F.sum("bn").over(before)).alias("pn"), *[zero(F.sum(f"b{s}").over(before)).alias(f"p{s}") for s in names], F.sum("bn").over(whole).alias("tn"), *[F.sum(f"b{s}").over(whole).alias(f"t{s}") for s in names], F.lead("first").over(over).alias("next_first"))
    inside = Window.partitionBy(*cell).orderBy("v")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    h = hist.join(part, cell)
    h = h.select(*keys, "v", "tn", *[f"t{s}" for s in names], (F.col("pn") + F.sum("n").over(upto)).alias("ln"), *[(F.col(f"p{s}") + F.sum(s).over(upto)).alias(f"l{s}") for s in names], F.coalesce(F.lead("v").over(inside), F.col("next_first")).alias("next"))
    h = h.where("next IS NOT NULL").withColumn("rn", F.col("tn") - F.col("ln")).where((F.col("ln") >= p.min_samples_leaf) & (F.col("rn") >= p.min_samples_leaf))
    left, total = [F.col(f"l{s}") for s in names], [F.col(f"t{s}") for s in names]
    right = [t - x for t, x in zip(total, left)]
    gain = _impurity(total, F.col("tn"), p) - (F.col("ln") / F.col("tn")) * _impurity(left, F.col("ln"), p) - (F.col("rn") / F.col("tn")) * _impurity(right, F.col("rn"), p)
    h = h.select("tree", "node", F.struct(F.round(gain, 12).alias("gain"), (-F.col("f")).alias("f"), (-F.when(F.isnan("next"), F.col("v")).otherwise((F.col("v") + F.col("next")) / 2)).alias("t")).alias("s"))
    best = h.groupBy("tree", "node").agg(F.max("s").alias("s"))
    if not p.classes:
        best = best.where("s.gain > 0")
    return best.select("tree", "node", (-F.col("s.f")).alias("feature"), (-F.col("s.t")).alias("threshold"), F.col("s.gain").alias("gain")).collect()


def importances(root: Node, p: int) -> list[float]:
    """Gains weighted by the rows they split, summing to 1 if any."""
    out = [0.0] * p
    for node in root.walk():
        if not node.is_leaf:
            out[node.feature] += node.gain * node.n
    total = sum(out)
    return [x / total for x in out] if total > 0 else out
