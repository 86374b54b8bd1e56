"""Nearest neighbours, exact. Few training rows travel to all tasks, as a tree; many are cut into cells of space.

Cells are the leaves of a k-d tree; the box of every cell is exact. A query first meets the rows of its own cell, whose k-th distance bounds
what it still needs; then only the cells whose boxes lie within that distance. Both meetings are equi-joins by cell, of packed blocks
of queries with packed blocks of rows, so adaptive execution can split a cell that most queries fall into. Inside a block, too, a
tree spares a query the leaves whose boxes lie beyond its k-th distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import Config, InvalidParameterError, require
from ..plans.frame import checked, number, partitions
from ..plans.scratch import discard, materialize
from . import metrics

#: Rows of a training block, and bytes up to which all blocks travel to every task.
BLOCK, SMALL = 2048, 32 << 20

#: Most cells of space, and training rows that their cuts are chosen from. Only the balance of cells depends on the choice.
CELLS, SAMPLE = 4096, 32768

#: Least rows of a leaf of a tree, queries that walk it at a time, and numbers that a step of the walk holds at most.
LEAF, WALK, STEP = 16, 4096, 1 << 21

#: Leaves of a tree that a query's first bound comes from.
BEAM = 4

WEIGHTS = ("uniform", "distance")

#: Weight of a neighbour at distance 0.
NEAR = 1e18


@dataclass(frozen=True)
class _Space:
    """Cuts of space (feature, value, children; a child below 0 is a cell), and the box of every cell that has rows."""

    feature: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray
    numbers: np.ndarray
    boxes: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        at = np.zeros(len(x), np.int64) if len(self.feature) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] <= self.value[node], self.low[node], self.high[node])
        return -at - 1

    def near(self, x: np.ndarray, reach: np.ndarray, home: np.ndarray, root: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the other cells whose boxes may hold something within their reach (distances are rounded, so a little beyond)."""
        gap = np.zeros((len(x), len(self.numbers)))
        for j in range(x.shape[1]):
            outside = np.maximum(np.maximum(self.boxes[None, :, 0, j] - x[:, j : j + 1], x[:, j : j + 1] - self.boxes[None, :, 1, j]), 0.0)
            gap += outside * outside
        row, cell = np.nonzero(((np.sqrt(gap) if root else gap) <= reach[:, None] * (1 + 1e-9)) & (self.numbers[None, :] != home[:, None]))
        return row, self.numbers[cell]


def _cuts(x: np.ndarray, least: int) -> list[tuple[int, float, int, int]]:
    """A k-d tree over some rows, at medians of the widest feature, down to `least` rows."""
    nodes: list[list] = []
    cells = 0
    stack = [(x, None, None)]
    while stack:
        rows, parent, side = stack.pop()
        feature = int((rows.max(0) - rows.min(0)).argmax()) if len(rows) else 0
        values = rows[:, feature]
        middle = float(np.median(values)) if len(rows) else 0.0
        if len(rows) and middle >= values.max() > values.min():  # more than half are the largest: the rest goes to one side
            middle = float(values[values < values.max()].max())
        below = values <= middle
        if len(rows) <= least or below.all():
            cells += 1
            mark = -cells
        else:
            mark = len(nodes)
            nodes.append([feature, middle, 0, 0])
            stack += [(rows[~below], mark, 3), (rows[below], mark, 2)]
        if parent is not None:
            nodes[parent][side] = mark
    return nodes


class _Tree:
    """Rows as a balanced k-d tree: halves at the middle of the widest feature, exact boxes on every level. Of equal rows only the k of least id
    are kept, since no query takes more. Distances are square roots, or squares where `root` is false."""

    def __init__(self, ids: np.ndarray, t: np.ndarray, k: int, root: bool = True):
        order = np.lexsort((ids, *t.T))
        ids, t = ids[order], t[order]
        place = np.arange(len(ids))
        start = np.maximum.accumulate(np.where(np.append(True, (t[1:] != t[:-1]).any(1)), place, 0)) if len(ids) else place
        ids, t = ids[place - start < k], t[place - start < k]
        depth = max(0, (len(ids) // max(LEAF, k)).bit_length() - 1)
        order, bounds, self.boxes = np.arange(len(ids)), np.array([0, len(ids)]), []
        for level in range(depth + 1 if len(ids) else 0):
            rows = t[order]
            box = np.minimum.reduceat(rows, bounds[:-1]), np.maximum.reduceat(rows, bounds[:-1])
            self.boxes.append(box)
            if level < depth:
                node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                order = order[np.lexsort((rows[np.arange(len(rows)), (box[1] - box[0]).argmax(1)[node]], node))]
                bounds = np.sort(np.concatenate([bounds, (bounds[:-1] + bounds[1:]) // 2]))
        self.ids, self.t, self.bounds, self.k, self.root = ids[order], t[order], bounds, k, root

    def _gap(self, level: int, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Distance of every x to the box of its node."""
        low, high = self.boxes[level]
        gap = np.zeros(len(x))
        for j in range(x.shape[1]):
            outside = np.maximum(np.maximum(low[node, j] - x[:, j], x[:, j] - high[node, j]), 0.0)
            gap += outside * outside
        return np.sqrt(gap) if self.root else gap

    def _leaves(self, leaf: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of every x's leaf and their distances; places beyond the leaf are rows of infinite distance numbered -1."""
        rows = self.bounds[leaf][:, None] + np.arange(np.diff(self.bounds).max())
        rows = np.where(rows < self.bounds[leaf + 1][:, None], rows, -1)
        d = np.zeros(rows.shape)
        for j in range(x.shape[1]):  # differences, not products: distances of equal rows are exactly 0
            d += (x[:, j : j + 1] - self.t[rows, j]) ** 2
        return rows, np.where(rows < 0, np.inf, np.sqrt(d) if self.root else d)

    def _best(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray):
        """The k nearest of every q, ties by id."""
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        able = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < self.k
        return q[able], ids[able], d[able]

    def _all(self, x: np.ndarray, reach: np.ndarray):
        """Every row against every query, BLOCK rows at a time."""
        parts = [(np.zeros(0, np.int64), self.ids[:0], np.zeros(0))]
        for a in range(0, len(x), 256):
            own = [(np.zeros(0, np.int64), self.ids[:0], np.zeros(0))]
            for b in range(0, len(self.ids), BLOCK):
                t, q = self.t[b : b + BLOCK], x[a : a + 256]
                d = np.zeros((len(q), len(t)))
                for j in range(t.shape[1]):
                    d += (q[:, j : j + 1] - t[None, :, j]) ** 2
                d = np.sqrt(d) if self.root else d
                row, at = np.nonzero(~(d > reach[a : a + 256, None]))  # no number at all comes last, but comes
                own.append(self._best(row + a, self.ids[b + at], d[row, at]))
            parts.append(self._best(*(np.concatenate(z) for z in zip(*own))))
        return tuple(np.concatenate(z) for z in zip(*parts))

    def nearest(self, x: np.ndarray, reach: np.ndarray | None = None):
        """(position of the query, id, distance) of the k nearest rows of every query, none beyond its reach."""
        reach = np.full(len(x), np.inf) if reach is None else reach
        odd = ~np.isfinite(x).all(1)
        at, size = np.flatnonzero(~odd), max(1, min(WALK, STEP // (2 * BEAM * max(LEAF, self.k))))
        parts = [self._walk(at[a : a + size], x, reach) for a in range(0, len(at), size)] if len(self.ids) else []
        parts.append(self._odd(np.flatnonzero(odd), x, reach))
        return tuple(np.concatenate(z) for z in zip(*parts))

    def _odd(self, at: np.ndarray, x: np.ndarray, reach: np.ndarray):
        """The queries at these positions, each with a value that isn't finite: all their distances are infinite or no number, whatever
        their finite values are, so all rows are searched once a pattern of such values."""
        own = x[at]
        kind = np.column_stack([np.select([np.isnan(own), own == np.inf, own == -np.inf], [1, 2, 3], 0), reach[at] < np.inf])
        _, first, pattern = np.unique(kind, axis=0, return_index=True, return_inverse=True)
        q, ids, d = self._all(own[first], reach[at[first]])
        start, n = np.searchsorted(q, np.arange(len(first))), np.bincount(q, minlength=len(first))
        pattern = pattern.reshape(-1)
        each = n[pattern]
        rows = np.repeat(start[pattern] - np.cumsum(each) + each, each) + np.arange(each.sum())
        return np.repeat(at, each), ids[rows], d[rows]

    def _walk(self, at: np.ndarray, x: np.ndarray, reach: np.ndarray):
        """The queries at these positions: first the BEAM nearest leaves, whose k-th distance bounds the rest, then down all boxes within it."""
        own, p, depth = x[at], x.shape[1], len(self.boxes) - 1
        leaf = np.zeros((len(at), 1), np.int64)
        for level in range(1, depth + 1):  # boxes touch where a feature repeats a value, so one way down may end far off
            leaf = (2 * leaf[:, :, None] + np.arange(2)).reshape(len(at), -1)
            if leaf.shape[1] > BEAM:
                gap = self._gap(level, leaf.reshape(-1), np.repeat(own, leaf.shape[1], 0)).reshape(leaf.shape)
                leaf = np.take_along_axis(leaf, np.argsort(gap, axis=1, kind="stable")[:, :BEAM], 1)
        near = self._leaves(leaf.reshape(-1), np.repeat(own, leaf.shape[1], 0))[1].reshape(len(at), -1)
        bound = np.minimum(reach[at], np.partition(near, self.k - 1, axis=1)[:, self.k - 1]) if near.shape[1] >= self.k else reach[at]
        q, node = np.arange(len(at)), np.zeros(len(at), np.int64)
        for level in range(1, depth + 1):
            q, node = np.repeat(q, 2), (2 * node[:, None] + np.arange(2)).reshape(-1)
            able = self._gap(level, node, own[q]) <= bound[q] * (1 + 1e-9)
            q, node = q[able], node[able]
            if level >= 5 and 4 * len(q) > len(at) << level:  # boxes spare too little
                q, ids, d = self._all(own, bound)
                return at[q], ids, d
            if len(q) * p > STEP and len(at) > 1:
                halves = [self._walk(half, x, reach) for half in np.array_split(at, 2)]
                return tuple(np.concatenate(z) for z in zip(*halves))
        best = (q[:0], self.ids[:0], np.zeros(0))
        size = max(1, STEP // (8 * max(LEAF, self.k)))
        for a in range(0, len(q), size):
            rows, d = self._leaves(node[a : a + size], own[q[a : a + size]])
            row, column = np.nonzero((rows >= 0) & (d <= bound[q[a : a + size], None]))
            found = (q[a + row], self.ids[rows[row, column]], d[row, column])
            best = self._best(*(np.concatenate(z) for z in zip(best, found)))
        q, ids, d = best
        return at[q], ids, d


def _doubles(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def _space(train: DataFrame, ids: str, x: Column, n: int, p: int, k: int) -> tuple[DataFrame, _Space]:
    """Training rows packed by cell (cell, ids, x) in blocks of about BLOCK, written; and the space. The driver holds SAMPLE rows for the cuts, then CELLS boxes."""
    d = train.select(F.col(ids).cast("long").alias("i"), x.alias("x"))
    some = d.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < max(1, min(1 << 20, (SAMPLE << 20) // max(n, 1)))).limit(4 * SAMPLE).toArrow()
    count = max(1, min(CELLS, n // max(BLOCK, 4 * k)))
    sample = _doubles(some.column("x").combine_chunks(), p) if some.num_rows else np.zeros((0, p))
    nodes = _cuts(sample, max(1, -(-len(sample) // count)))
    arrays = [np.array([v[c] for v in nodes]) for c in range(4)]
    bare = _Space(*arrays, np.zeros(0, np.int64), np.zeros((0, 2, p)))

    def place(batches):
        for b in batches:
            cell = bare.cells(_doubles(b.column("x"), p))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("x"), pa.array(cell)], names=["i", "x", "cell"])

    placed = materialize(d.mapInArrow(place, "i long, x array<double>, cell long"), "placed")
    values = [F.col("x")[j] for j in range(p)]
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.array(*[F.min(v) for v in values]).alias("low"), F.array(*[F.max(v) for v in values]).alias("high")).collect()  # a row a cell
    space = _Space(*arrays, np.array([r.cell for r in found], np.int64), np.array([[r.low, r.high] for r in found], float).reshape(-1, 2, p))
    parts = train.sparkSession.createDataFrame([(r.cell, -(-r.n // BLOCK)) for r in found], "cell long, parts long")  # CELLS rows at most
    packed = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts"))).groupBy("cell", "part").agg(F.collect_list(F.struct("i", "x")).alias("rows"))
    blocks = materialize(packed.select("cell", F.col("rows.i").alias("ids"), F.flatten("rows.x").alias("x")), "train")
    discard(placed)
    return blocks, space


def _packed(q: DataFrame) -> DataFrame:
    """Queries (q, x, r, cell) packed by cell in blocks of about BLOCK: cell, qs, qx, rs."""
    counts = q.groupBy("cell").agg(F.count("*").alias("n"))
    parts = F.pmod(F.xxhash64("q"), F.ceil(F.col("n") / BLOCK))
    rows = q.join(counts, "cell").withColumn("part", parts).groupBy("cell", "part").agg(F.collect_list(F.struct("q", "x", "r")).alias("rows"))
    return rows.select("cell", F.col("rows.q").alias("qs"), F.flatten("rows.x").alias("qx"), F.col("rows.r").alias("rs"))


def neighbours(train: DataFrame, queries: DataFrame, k: int, x: Column, train_id: str, query_id: str, n: int | None = None, root: bool = True, within: float = float("inf")) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest training rows of every query, ties by id. x: array of doubles, the same in both.

    Training rows go to all tasks while their size allows it (it is computed from the row count); beyond that by cells of
    space. A task holds a block of queries and a block of rows at a time. The result is a written table in the second case.
    Without `root` distances are squares. Nothing beyond `within`, in the same measure, is found.
    """
    spark = train.sparkSession
    n = train.count() if n is None else n
    p = len(train.select(x.alias("x")).first()["x"]) if n else 1
    q = queries.select(F.col(query_id).cast("long").alias("q"), x.alias("x"))

    def out(qs, ids, d):
        return pa.RecordBatch.from_arrays([pa.array(qs), pa.array(ids), pa.array(d)], names=["q", "i", "d"])

    def ranked(found: DataFrame) -> DataFrame:
        top = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "i"))).where(F.col("rank") <= k)
        return top.select(F.col("q").alias("query"), F.col("i").alias("neighbour"), F.col("d").alias("distance"), "rank")

    if n * p * 8 <= SMALL:
        rows = train.select(F.col(train_id).cast("long").alias("i"), x.alias("x")).toArrow()
        ids, t = rows.column("i").to_numpy(), _doubles(rows.column("x").combine_chunks(), p) if rows.num_rows else np.zeros((0, p))
        held = spark.sparkContext.broadcast(_Tree(ids, t, k, root))

        def scan(batches):
            for b in batches:
                qs, qx = b.column("q").to_numpy(), _doubles(b.column("x"), p)
                if len(held.value.ids):
                    at, ids, d = held.value.nearest(qx, np.full(len(qs), within))
                    yield out(qs[at], ids, d)

        # Dealt anew: a table of few files or row groups would leave all queries to few tasks.
        return ranked(q.repartition(partitions(spark), "q").mapInArrow(scan, "q bigint, i bigint, d double"))

    blocks, space = _space(train, train_id, x, n, p, k)
    shared = spark.sparkContext.broadcast(space)  # CELLS boxes at most
    kind = "q bigint, x array<double>, r double, cell bigint"

    def home(batches):
        for b in batches:
            cell = shared.value.cells(_doubles(b.column("x"), p))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("x"), pa.array(np.full(len(cell), within)), pa.array(cell)], names=["q", "x", "r", "cell"])

    def further(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                row, cell = shared.value.near(_doubles(b.column("x"), p), b.column("r").to_numpy(), b.column("cell").to_numpy(), root)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("q").take(rows), b.column("x").take(rows), b.column("r").take(rows), pa.array(cell)], names=["q", "x", "r", "cell"])

    def meet(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                qs, rs, ids = (one.column(c).flatten().to_numpy() for c in ("qs", "rs", "ids"))
                at, ids, d = _Tree(ids, _doubles(one.column("x"), p), k, root).nearest(_doubles(one.column("qx"), p), rs)
                yield out(qs[at], ids, d)

    def met(some: DataFrame) -> DataFrame:
        return _packed(some).join(blocks, "cell").select("qs", "qx", "rs", "ids", "x").mapInArrow(meet, "q bigint, i bigint, d double")

    homes = materialize(q.mapInArrow(home, kind), "homes")
    first = materialize(ranked(met(homes)), "first")
    reach = first.where(F.col("rank") == k).select(F.col("query").alias("q"), F.col("distance").alias("reach"))
    more = homes.join(reach, "q", "left").select("q", "x", F.coalesce("reach", F.lit(within)).alias("r"), "cell")
    wide = materialize(more.mapInArrow(further, kind), "further")
    discard(homes)
    both = first.select(F.col("query").alias("q"), F.col("neighbour").alias("i"), F.col("distance").alias("d")).union(met(wide))
    result = materialize(ranked(both), "neighbours")
    discard(first, wide, blocks)
    return result


def _valid(k: int, weights: str, n: int) -> str:
    weights = weights or "uniform"
    if weights not in WEIGHTS:
        raise InvalidParameterError(f"weights must be one of {WEIGHTS}")
    if k <= 0 or k > n:
        raise InvalidParameterError("k must lie between 1 and the number of rows")
    return weights


@dataclass(frozen=True)
class _Config(Config):
    k: int = 5
    weights: str = "uniform"

    def _train(self, df, features, label, row_id):
        n = checked(df, features, label)
        weights = _valid(self.k, self.weights, n)
        rows = df.select(F.col(row_id).cast("long").alias("row_id"), *[number(c).alias(c) for c in features], number(label).alias("label"))
        return materialize(rows, "knn"), weights, n


@dataclass(frozen=True)
class _Model:
    features: tuple[str, ...]
    rows: DataFrame
    k: int
    weights: str
    n: int

    def _weighted(self, df: DataFrame, row_id: str) -> DataFrame:
        """(query, label, w) of the k nearest."""
        require(df, [*self.features, row_id])
        x = F.array(*[number(c) for c in self.features])
        near = neighbours(self.rows, df, self.k, x, "row_id", row_id, self.n)
        w = F.lit(1.0) if self.weights == "uniform" else F.when(F.col("distance") == 0, NEAR).otherwise(1.0 / F.col("distance"))
        return near.join(self.rows.select(F.col("row_id").alias("neighbour"), "label"), "neighbour").select("query", "label", w.alias("w"))


@dataclass(frozen=True)
class KNeighborsClassifier(_Config):
    def fit(self, df: DataFrame, features: list[str], label: str = "label", row_id: str = "row_id") -> "KNeighborsClassifierModel":
        rows, weights, n = self._train(df, features, label, row_id)
        classes = tuple(sorted(r[0] for r in rows.select("label").distinct().collect()))
        return KNeighborsClassifierModel(tuple(features), rows, self.k, weights, n, classes)


@dataclass(frozen=True)
class KNeighborsClassifierModel(_Model):
    classes: tuple[float, ...]

    def predict(self, df: DataFrame, output: str = "prediction", row_id: str = "row_id") -> DataFrame:
        """The class of most weight, the smallest of equals."""
        votes = self._weighted(df, row_id).groupBy("query", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("query").agg(F.max_by("label", F.struct(F.col("w"), -F.col("label"))).alias(output))
        return df.join(best.withColumnRenamed("query", "_q"), F.col(f"`{row_id}`").cast("long") == F.col("_q")).drop("_q")

    def score(self, df: DataFrame, label: str = "label", row_id: str = "row_id") -> float:
        return metrics.accuracy(self.predict(df, "_p", row_id), label, "_p")


@dataclass(frozen=True)
class KNeighborsRegressor(_Config):
    def fit(self, df: DataFrame, features: list[str], label: str = "label", row_id: str = "row_id") -> "KNeighborsRegressorModel":
        rows, weights, n = self._train(df, features, label, row_id)
        return KNeighborsRegressorModel(tuple(features), rows, self.k, weights, n)


@dataclass(frozen=True)
class KNeighborsRegressorModel(_Model):
    def predict(self, df: DataFrame, output: str = "prediction", row_id: str = "row_id") -> DataFrame:
        """Weighted mean of the k nearest labels. A row with a null feature has no weights by distance, so its mean is null."""
        best = self._weighted(df, row_id).groupBy("query").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias(output))
        found = df.join(best.withColumnRenamed("query", "_q"), F.col(f"`{row_id}`").cast("long") == F.col("_q")).drop("_q")
        known = F.forall(F.array(*[number(c) for c in self.features]), lambda v: v.isNotNull())
        return found.withColumn(output, F.when(known, F.col(f"`{output}`"))) if self.weights == "distance" else found

    def score(self, df: DataFrame, label: str = "label", row_id: str = "row_id") -> float:
        return metrics.r2(self.predict(df, "_p", row_id), label, "_p")
