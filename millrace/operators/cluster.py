"""k-means and density clustering."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from itertools import product
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Config, ConvergenceWarning, InvalidParameterError, require
from ..functions.rng import key
from ..plans.frame import checked, number, numbered
from ..plans.scratch import discard, materialize
from .neighbors import neighbours


def squared_distance(features, center) -> Column:
    total = F.lit(0.0)
    for c, v in zip(features, center):
        d = number(c) - F.lit(float(v))
        total = total + d * d
    return total


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest center (the first of equals) and its squared distance, summed over the features in order."""
    d = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        d += (x[:, j : j + 1] - centers[None, :, j]) ** 2
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def assign_sums(d: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Lloyd assignment: counts, sums by center, inertia. Partial sums a partition, combined before the exchange."""
    k, p = centers.shape

    def part(batches):
        sums = np.zeros((k, p + 2))
        for b in batches:
            x = np.stack([b.column(j).to_numpy() for j in range(p)], axis=1)
            at, near = _nearest(x, centers)
            np.add.at(sums[:, :p], at, x)
            sums[:, p] += np.bincount(at, minlength=k)
            sums[:, p + 1] += np.bincount(at, weights=near, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.reshape(-1))], names=["cell", "v"])

    got = np.zeros(k * (p + 2))
    for r in d.mapInArrow(part, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        got[r.cell] = r.v
    got = got.reshape(k, p + 2)
    return got[:, p], got[:, :p], float(got[:, p + 1].sum())


@dataclass(frozen=True)
class KMeans(Config):
    n_clusters: int = 8
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0
    n_init: int = 10

    def fit(self, df: DataFrame, features: list[str], init=None) -> "KMeansModel":
        """Lloyd iterations from k-means++ centers (or `init`); the run of least inertia, the first of equals.

        As labels and inertia count the assignment before the last move of the centers, so does `inertia` here.
        """
        n = checked(df, features)
        if not 0 < self.n_clusters <= n:
            raise InvalidParameterError("n_clusters must lie between 1 and the number of rows")
        d = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(features)])
        d = materialize(d, "kmeans").cache()
        try:
            best = None
            for run in range(1 if init is not None else max(1, self.n_init)):
                centers = np.array(init, float) if init is not None else self._plus_plus(d, len(features), run)
                got = self._lloyd(d, centers, run)
                if best is None or got[1] < best[1]:
                    best = got
        finally:
            d.unpersist()
        return KMeansModel(tuple(features), tuple(map(tuple, best[0].tolist())), best[1], best[2], tuple(map(tuple, best[3].tolist())))

    def _pick(self, d: DataFrame, p: int, weight: Column, *mark) -> np.ndarray:
        """One row with probability in proportion to its weight: the least of exponential keys, one aggregation."""
        u = F.conv(F.substring(key(self.seed, *[F.lit(str(m)) for m in mark], *[F.col(f"x{i}") for i in range(p)]), 1, 12), 16, 10).cast("double")
        draw = -F.log((u + 1) / F.lit(float(1 << 48) + 1)) / weight
        got = d.where(weight > 0).agg(F.min_by(F.array(*[F.col(f"x{i}") for i in range(p)]), F.struct(draw, *[F.col(f"x{i}") for i in range(p)]))).first()[0]
        return None if got is None else np.array(got)

    def _plus_plus(self, d: DataFrame, p: int, run: int) -> np.ndarray:
        names = [f"x{i}" for i in range(p)]
        centers = [self._pick(d, p, F.lit(1.0), run, 0)]
        while len(centers) < self.n_clusters:
            near = F.least(*[squared_distance(names, c) for c in centers]) if len(centers) > 1 else squared_distance(names, centers[0])
            new = self._pick(d, p, near, run, len(centers))
            centers.append(centers[0] if new is None else new)  # fewer distinct rows than centers
        return np.array(centers)

    def _lloyd(self, d: DataFrame, centers: np.ndarray, run: int):
        inertia, steps, used = 0.0, 0, centers
        for steps in range(1, self.max_iter + 1):
            used = centers
            counts, sums, inertia = assign_sums(d, centers)
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
            for k in np.flatnonzero(counts == 0):  # an empty cluster starts again from a row
                new[k] = self._pick(d, centers.shape[1], F.lit(1.0), run, "empty", steps, int(k))
            moved, centers = ((new - centers) ** 2).sum(1).max(), new
            if moved <= self.tol**2:
                break
        else:
            warnings.warn("k-means stopped at max_iter", ConvergenceWarning, stacklevel=2)
        return centers, inertia, steps, used


@dataclass(frozen=True)
class KMeansModel:
    """assigned: the centers that labels and inertia of the fit belong to."""

    features: tuple[str, ...]
    centroids: tuple[tuple[float, ...], ...]
    inertia: float
    iterations: int
    assigned: tuple[tuple[float, ...], ...]

    def _column(self, centers) -> Column:
        if len(centers) == 1:
            return F.lit(0)
        d = F.array(*[squared_distance(self.features, c) for c in centers])
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, self._column(self.centroids))

    def labels(self, df: DataFrame, output: str = "label") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, self._column(self.assigned))


def _within(features, eps: float) -> Column:
    total = F.lit(0.0)
    for i in range(len(features)):
        d = F.col(f"x{i}") - F.col(f"y{i}")
        total = total + d * d
    return F.sqrt(total) <= F.lit(eps)


def _boxes(p: int, near: bool) -> Column:
    """Least or largest distance of two rows in boxes (lo*, hi*) and (blo*, bhi*). Sums and roundings are those of `_within`, so the bounds hold exactly."""
    total = F.lit(0.0)
    for k in range(p):
        lo, hi, blo, bhi = (F.col(f"{c}{k}") for c in ("lo", "hi", "blo", "bhi"))
        d = F.greatest(lo - bhi, blo - hi, F.lit(0.0)) if near else F.greatest(hi - blo, bhi - lo)
        total = total + d * d
    return F.sqrt(total)


def _to_box(p: int) -> Column:
    """Distance of the row x* to the box (blo*, bhi*)."""
    total = F.lit(0.0)
    for k in range(p):
        d = F.greatest(F.col(f"x{k}") - F.col(f"bhi{k}"), F.col(f"blo{k}") - F.col(f"x{k}"), F.lit(0.0))
        total = total + d * d
    return F.sqrt(total)


def _box_aggregates(p: int) -> list[Column]:
    return [f(f"x{k}").alias(f"{c}{k}") for k in range(p) for f, c in ((F.min, "lo"), (F.max, "hi"))]


def _other(cells: DataFrame, p: int, *more: str) -> DataFrame:
    """The cells as the other side of a pair: h and blo*, bhi*."""
    return cells.select(F.col("k").alias("h"), *[F.col(f"{c}{k}").alias(f"b{c}{k}") for k in range(p) for c in ("lo", "hi")], *more)


def _as_y(rows: DataFrame, p: int, *more: str) -> DataFrame:
    return rows.select(F.col("k").alias("h"), *[F.col(f"x{k}").alias(f"y{k}") for k in range(p)], *more)


@dataclass(frozen=True)
class DBSCAN(Config):
    eps: float = 0.5
    min_samples: int = 5

    def fit(self, df: DataFrame, features: list[str], row_id: str = "row_id") -> "DBSCANModel":
        """Labels by row: clusters are numbered by their least core id, a border row takes the least cluster that reaches it, noise is -1.

        Rows meet by cells whose diagonal is less than eps. All rows of a cell with min_samples rows are core, and the core rows of
        a cell are one cluster, so counts compare rows of sparse cells alone, and links join cells, not rows. Pairs of cells whose
        boxes settle the matter compare no rows at all.
        """
        if self.eps <= 0 or self.min_samples <= 0:
            raise InvalidParameterError("eps and min_samples must be positive")
        checked(df, [*features, row_id])
        p = len(features)
        side = self.eps / sqrt(p) * (1 - 1e-9)
        xs = [f"x{k}" for k in range(p)]
        x = df.select(F.col(row_id).cast("long").alias("i"), *[number(c).alias(n) for c, n in zip(features, xs)])
        x = materialize(x.withColumn("k", F.array(*[F.floor(F.col(n) / F.lit(side)) for n in xs])), "dbscan")
        cells = materialize(x.groupBy("k").agg(F.count("*").alias("n"), *_box_aggregates(p)), "cells")
        pairs = materialize(self._pairs(cells, p, ceil(self.eps / side)), "pairs")  # k, h, n of h, whole: all rows of the two are within eps
        sure = pairs.where("whole").groupBy("k").agg(F.sum("n").alias("more"))
        counted = cells.join(sure, "k", "left").select("k", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        counted = materialize(counted, "counted")
        open_ = x.join(counted.where(F.col("n") < self.min_samples), "k")  # fewer than min_samples rows a cell
        tests = pairs.where("not whole").select("k", "h")
        some = open_.join(tests, "k").join(_as_y(x, p), "h").where(_within(xs, self.eps)).groupBy("i").agg(F.count("*").alias("more"))
        checked_rows = materialize(open_.join(some, "i", "left").select("i", "k", *xs, (F.col("n") + F.coalesce("more", F.lit(0)) >= self.min_samples).alias("core")), "open")
        core = x.join(counted.where(F.col("n") >= self.min_samples).select("k"), "k", "left_semi").select("i", "k", *xs)
        core = materialize(core.union(checked_rows.where("core").select("i", "k", *xs)), "core")
        clusters = self._clusters(core, pairs, p)  # k, cluster
        cores = materialize(core.join(clusters, "k").select("i", *xs, "k", "cluster"), "model")
        border = checked_rows.where("not core").select("i", "k", *xs)
        own = border.join(clusters, "k").select("i", "cluster")
        whole = border.join(pairs.where("whole").select("k", "h"), "k").join(clusters.withColumnRenamed("k", "h"), "h").select("i", "cluster")
        tried = border.join(tests, "k").join(_as_y(cores, p, "cluster"), "h").where(_within(xs, self.eps)).select("i", "cluster")
        reach = own.union(whole).union(tried).groupBy("i").agg(F.min("cluster").alias("cluster"))
        found = cores.select("i", "cluster").union(reach)
        labels = materialize(x.select("i").join(found, "i", "left").select(F.col("i").alias(row_id), F.coalesce("cluster", F.lit(-1)).alias("label")), "labels")
        discard(x, cells, pairs, counted, checked_rows, core, clusters)
        return DBSCANModel(tuple(features), self.eps, row_id, cores.drop("k"), labels)

    def _pairs(self, cells: DataFrame, p: int, reach: int) -> DataFrame:
        """Pairs of different cells whose boxes come within eps: equal squares of `reach` cells, one side copied to the squares around it (first three features)."""
        dims = range(min(p, 3))
        shifts = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"d{i}") for i, s in enumerate(v)]) for v in product((-1, 0, 1), repeat=len(dims))])).alias("s")
        a = cells.drop("n").select("*", shifts).select("*", *[(F.floor(F.col("k")[i] / reach) + F.col(f"s.d{i}")).alias(f"c{i}") for i in dims]).drop("s")
        b = _other(cells, p, "n").select("*", *[F.floor(F.col("h")[i] / reach).alias(f"c{i}") for i in dims])
        met = a.join(b, [f"c{i}" for i in dims]).where((F.col("k") != F.col("h")) & (_boxes(p, True) <= self.eps))
        return met.select("k", "h", "n", (_boxes(p, False) <= self.eps).alias("whole"))

    def _clusters(self, core: DataFrame, pairs: DataFrame, p: int) -> DataFrame:
        """(k, cluster) of the cells with core rows.

        Two cells are linked by their boxes, or where the row nearest to the other box has a partner there, both linear. What is
        still apart after that is compared row by row, as far as the rows lie within eps of the other cell's box.
        """
        xs = [f"x{k}" for k in range(p)]
        cells = materialize(core.groupBy("k").agg(F.min("i").alias("g"), *_box_aggregates(p)), "corecells")
        met = pairs.select("k", "h").join(cells, "k").join(_other(cells, p, F.col("g").alias("gh")), "h").where(F.col("g") < F.col("gh")).where(_boxes(p, True) <= self.eps)
        met = materialize(met.withColumn("linked", _boxes(p, False) <= self.eps).select("k", "h", "g", "gh", "linked", *[f"b{c}{k}" for k in range(p) for c in ("lo", "hi")]), "met")
        rest = met.where("not linked").drop("linked")
        nearest = core.join(rest, "k").groupBy("g", "gh", "h").agg(F.min_by(F.struct(*xs), F.struct(_to_box(p), F.col("i"))).alias("x")).select("g", "gh", "h", "x.*")
        hit = nearest.join(_as_y(core, p), "h").where(_within(xs, self.eps)).select("g", "gh").distinct()
        links = materialize(met.where("linked").select("g", "gh").union(hit), "links")
        label = _min_labels(cells.select(F.col("g").alias("i")), _both(links))
        apart = rest.join(label.select(F.col("i").alias("g"), F.col("c").alias("cg")), "g").join(label.select(F.col("i").alias("gh"), F.col("c").alias("ch")), "gh").where("cg <> ch")
        near = core.join(apart, "k").where(_to_box(p) <= self.eps).select("h", "cg", "ch", *xs).distinct()
        late = materialize(near.join(_as_y(core, p).distinct(), "h").where(_within(xs, self.eps)).select(F.col("cg").alias("g"), F.col("ch").alias("gh")).distinct(), "links")
        final = label
        if not late.isEmpty():
            roots = _min_labels(label.select(F.col("c").alias("i")).distinct(), _both(late))
            final = label.join(roots.select(F.col("i").alias("c"), F.col("c").alias("root")), "c").select("i", F.col("root").alias("c"))
        order = numbered(final.select("c").distinct(), [F.col("c")], "cluster").select("c", F.col("cluster").cast("int").alias("cluster"))
        out = materialize(cells.select("k", F.col("g").alias("i")).join(final, "i").join(order, "c").select("k", "cluster"), "clusters")
        discard(cells, met, links, late)
        return out


def _both(links: DataFrame) -> DataFrame:
    """Links g, gh as edges i, j in both directions."""
    return materialize(links.select(F.col("g").alias("i"), F.col("gh").alias("j")).union(links.select("gh", "g")), "edges")


def _min_labels(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """(i, c): least node connected to each, by neighbours' least labels and then the labels' own labels, which halves the way each round."""
    cur = held = materialize(nodes.select("i", F.col("i").alias("c")), "labels")
    for _ in range(limit):
        near = edges.join(cur.select(F.col("i").alias("j"), "c"), "j").groupBy("i").agg(F.min("c").alias("m"))
        step = cur.join(near, "i", "left").select("i", F.least("c", F.coalesce("m", "c")).alias("n"), "c")
        jump = step.join(step.select(F.col("i").alias("n"), F.col("n").alias("nn")), "n", "left")
        nxt = materialize(jump.select("i", F.least("n", F.coalesce("nn", "n")).alias("c"), F.col("c").alias("was")), "labels")
        discard(held)
        cur, held = nxt.select("i", "c"), nxt
        if nxt.where("c <> was").isEmpty():
            return cur
    raise RuntimeError("labels did not settle")


@dataclass(frozen=True)
class DBSCANModel:
    features: tuple[str, ...]
    eps: float
    row_id: str
    cores: DataFrame
    labels: DataFrame

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Cluster of the nearest core row within eps (the earlier of equals), else -1."""
        require(df, [*self.features, self.row_id])
        p = len(self.features)
        xs = [f"x{k}" for k in range(p)]
        asked = df.select(F.col(self.row_id).cast("long").alias("q"), *[number(c).alias(n) for c, n in zip(self.features, xs)]).where(~F.exists(F.array(*xs), lambda v: v.isNull() | F.isnan(v)))
        # Of equal core rows the earliest: copies of a row cost a query nothing.
        cores = self.cores.groupBy(*[(F.col(n) + 0.0).alias(n) for n in xs]).agg(F.min(F.struct("i", "cluster")).alias("c")).select("c.i", "c.cluster", *xs)
        cores = materialize(cores, "cores")
        near = neighbours(cores, asked, 1, F.array(*xs), "i", "q", root=False, within=self.eps**2 * (1 + 1e-9)).where(F.sqrt("distance") <= F.lit(self.eps))
        best = near.join(cores.select(F.col("i").alias("neighbour"), F.col("cluster").alias(output)), "neighbour").select(F.col("query").alias("q"), output)
        return df.join(best, F.col(f"`{self.row_id}`").cast("long") == F.col("q"), "left").drop("q").withColumn(output, F.coalesce(output, F.lit(-1)))
