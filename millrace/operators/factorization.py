"""Non-negative matrix factorisation: two tables of factors meet the entries in turns."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Config, ConvergenceWarning, EmptyInputError, InvalidParameterError
from ..functions.rng import uniform
from ..plans.scratch import discard, materialize
from .sparse import Sparse

#: Keeps divisors from zero, and the most components (their products with one another are literals of a plan).
EPSILON, MOST = 1e-12, 64


@dataclass(frozen=True)
class NMF(Config):
    """Multiplicative updates for the squared error. Factors start from digests of (seed, side, number, component)."""

    n_components: int = 2
    max_iter: int = 200
    tol: float = 1e-4
    seed: int = 0

    def fit(self, matrix: Sparse) -> "NMFModel":
        """Rows and columns without entries get factors of zero after the first update.

        A round joins the entries with the rows' factors and sums by column, then with the columns' factors and sums by row;
        sums are combined in tasks before their exchange, so a column or row with most of the entries is no single task's, and the join splits it.
        Factors are written each half round. Only the products of components with one another go to the driver. Ends when the loss
        falls by less than `tol` of its first value in a round, or with a warning.
        """
        k = self.n_components
        if not 1 <= k <= MOST or self.max_iter < 1 or self.tol < 0:
            raise InvalidParameterError(f"1 <= n_components <= {MOST}, max_iter >= 1 and tol >= 0 are needed")
        # The sum of equal places, as a sparse matrix means it.
        entries = materialize(matrix.entries.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0"), "entries")
        n, low, square, spoilt = entries.agg(F.count("*"), F.min("value"), F.sum(F.col("value") * F.col("value")), F.sum((F.isnan("value") | F.col("value").isNull()).cast("long"))).first()
        if not n or spoilt or low < 0:
            discard(entries)
            raise EmptyInputError("no entries") if not n else InvalidParameterError("entries may not be negative or missing")
        w, h = (materialize(self._begin(entries, side), "factors") for side in ("row", "col"))
        losses: list[float] = []
        for _ in range(self.max_iter):
            h, inner, gram = self._half(entries, w, h, "row", "col")
            # |V - W H|^2 = |V|^2 - 2 <V, W H> + <W'W, HH'>, with what the update has summed anyway
            losses.append(square - 2 * inner + float((gram * _products(h, k)).sum()))
            w, _, _ = self._half(entries, h, w, "col", "row")
            if len(losses) > 1 and losses[-2] - losses[-1] < self.tol * losses[0]:
                break
        else:
            warnings.warn("the factorisation stopped at max_iter", ConvergenceWarning, stacklevel=2)
        discard(entries)
        return NMFModel(w, h, k, tuple(losses), square)

    def _begin(self, entries: DataFrame, side: str) -> DataFrame:
        return entries.select(side).distinct().select(F.col(side).cast("long").alias("id"), *[(uniform(self.seed, F.lit(side), F.col(side), F.lit(c)) + 0.01).alias(f"f{c}") for c in range(self.n_components)])

    def _half(self, entries: DataFrame, fixed: DataFrame, moving: DataFrame, by: str, to: str) -> tuple[DataFrame, float, np.ndarray]:
        """New factors of the side `to`; the entries' product with both; the products of the fixed side's components. Discards the old factors."""
        k = self.n_components
        gram = _products(fixed, k)
        sums = entries.join(fixed, entries[by] == fixed["id"]).groupBy(F.col(to).cast("long").alias("id")).agg(*[F.sum(F.col("value") * F.col(f"f{c}")).alias(f"s{c}") for c in range(k)])
        parts = sums.join(moving, "id")
        new = [F.col(f"f{c}") * F.col(f"s{c}") / (sum((F.lit(float(gram[c, j])) * F.col(f"f{j}") for j in range(k)), F.lit(0.0)) + EPSILON) for c in range(k)]
        held = materialize(parts.select("id", *[x.alias(f"f{c}") for c, x in enumerate(new)], sum((F.col(f"s{c}") * x for c, x in enumerate(new)), F.lit(0.0)).alias("inner")), "factors")
        inner = held.agg(F.sum("inner")).first()[0]
        discard(moving)
        kept = held.drop("inner")
        kept.written_to = held.written_to
        return kept, inner, gram


def _products(factors: DataFrame, k: int) -> np.ndarray:
    """Sums of products of the components over all ids: one aggregation."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = factors.agg(*[F.sum(F.col(f"f{i}") * F.col(f"f{j}")) for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, got):
        out[i, j] = out[j, i] = v or 0.0
    return out


@dataclass(frozen=True)
class NMFModel:
    """Factors of rows and of columns (id, f0, f1, ...) are tables below the checkpoint folder; `close` deletes them. losses: squared error after each round's first half."""

    rows: DataFrame
    columns: DataFrame
    n_components: int
    losses: tuple[float, ...]
    total: float

    def close(self) -> None:
        discard(self.rows, self.columns)

    def values(self, places: DataFrame) -> DataFrame:
        """Adds the approximation as `value` to places (row, col); 0 where a row or column has no entries."""
        k = self.n_components
        name = lambda side: [F.col("id").alias(f"_{side}"), *[F.col(f"f{c}").alias(f"_{side}{c}") for c in range(k)]]
        d = places.join(self.rows.select(*name("r")), F.col("row") == F.col("_r"), "left").join(self.columns.select(*name("c")), F.col("col") == F.col("_c"), "left")
        total: Column = sum((F.col(f"_r{c}") * F.col(f"_c{c}") for c in range(k)), F.lit(0.0))
        return d.select(*places.columns, F.coalesce(total, F.lit(0.0)).alias("value"))
