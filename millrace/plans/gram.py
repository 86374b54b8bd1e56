"""Sufficient statistics in one aggregation: counts, means and centred cross products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import EmptyInputError, InvalidParameterError

#: Up to this many columns all products are aggregate expressions of one plan; beyond it blocks go through matrix products.
EXPRESSIONS = 24


@dataclass(frozen=True)
class Moments:
    """n, means, and sums of products of deviations from the means."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def raw(self) -> np.ndarray:
        """Sums of products about zero."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)


def moments(df: DataFrame, columns: list[Column]) -> Moments:
    """Moments of the columns over all rows; null or NaN values and empty input raise."""
    p = len(columns)
    named = [c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    d = df.select(*named)
    bad = F.sum(sum(((F.col(f"c{i}").isNull() | F.isnan(f"c{i}")).cast("long") for i in range(p)), F.lit(0).cast("long")))
    means = [F.avg(f"c{i}") for i in range(p)]
    if p <= EXPRESSIONS:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        got = d.agg(F.count("*"), bad, *means, *[F.covar_pop(f"c{i}", f"c{j}") for i, j in pairs]).first()
        n = _counted(got)
        scatter = np.zeros((p, p))
        for (i, j), v in zip(pairs, got[2 + p :]):
            scatter[i, j] = scatter[j, i] = n * v
        return Moments(n, np.array(got[2 : 2 + p], float), scatter)
    got = d.agg(F.count("*"), bad, *means).first()
    n, mean = _counted(got), np.array(got[2:], float)

    def products(batches):
        """One p x p matrix a partition, as rows: the sums that follow are combined before their exchange."""
        total = np.zeros((p, p))
        for b in batches:
            x = np.stack([b.column(i).to_numpy() for i in range(p)], axis=1) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p)), pa.array(total.reshape(-1))], names=["cell", "v"])

    rows = d.mapInArrow(products, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    scatter = np.zeros(p * p)
    for r in rows:
        scatter[r.cell] = r.v
    return Moments(n, mean, scatter.reshape(p, p))


def _counted(got) -> int:
    if not got[0]:
        raise EmptyInputError("no rows")
    if got[1]:
        raise InvalidParameterError(f"{got[1]} null or NaN values; impute them first")
    return got[0]


def dot(features: list[str], weights, intercept: float = 0.0) -> Column:
    """Weighted sum as one column expression."""
    total = F.lit(float(intercept))
    for f, w in zip(features, weights):
        total = total + F.col(f"`{f}`").cast("double") * F.lit(float(w))
    return total
