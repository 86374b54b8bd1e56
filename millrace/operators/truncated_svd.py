"""Truncated singular value decomposition by a randomised range finder, without a Gram matrix.

Rows (dense arrays, or indices and values) stay where they are. A pass multiplies them by a narrow matrix of directions and keeps
only the triangular factor of the products: block after block in a task, then task by task in a tree. A second pass
multiplies the orthogonal rows back. Passes repeat on the directions found until the singular values settle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Config, EmptyInputError, InvalidParameterError, require
from ..plans.frame import number
from ..plans.scratch import discard, materialize
from .sparse import Sparse

#: Numbers of the directions' matrix, rows that a task multiplies at a time, and triangular factors that one task joins.
CELLS, BLOCK, FAN = 1 << 25, 4096, 16

#: Columns up to which directions span all of them, so that no round is needed but to confirm.
ALL = 128


@dataclass(frozen=True)
class _Block:
    """Some rows: the position of every value's row, its column, the value; or a full matrix."""

    rows: int
    at: np.ndarray | None
    columns: np.ndarray | None
    values: np.ndarray

    def times(self, m: np.ndarray) -> np.ndarray:
        if self.at is None:
            return self.values @ m
        out = np.zeros((self.rows, m.shape[1]))
        np.add.at(out, self.at, self.values[:, None] * m[self.columns])
        return out

    def back(self, out: np.ndarray, q: np.ndarray) -> None:
        """Adds the transposed rows times q."""
        if self.at is None:
            out += self.values.T @ q
        else:
            np.add.at(out, self.columns, self.values[:, None] * q[self.at])


def _blocks(batches, columns: int, sparse: bool):
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            v = part.column("v")
            values = v.flatten().to_numpy(zero_copy_only=False)
            if not sparse:
                yield _Block(len(v), None, None, values.reshape(len(v), columns))
            else:
                lens = np.diff(v.offsets.to_numpy())
                yield _Block(len(v), np.repeat(np.arange(len(v)), lens), part.column("c").flatten().to_numpy(zero_copy_only=False), values)


def _triangle(stacked: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stacked, mode="r")


def _triangles(rows: DataFrame, m: np.ndarray, columns: int, sparse: bool) -> np.ndarray:
    """R of a tall-skinny QR of rows times m: a factor a task, joined FAN at a time."""
    wide = m.shape[1]

    def factor(batches):
        r = np.zeros((0, wide))
        for b in _blocks(batches, columns, sparse):
            r = _triangle(np.concatenate([r, b.times(m)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["r"])

    def join(batches):
        r = np.zeros((0, wide))
        for b in batches:
            for one in b.column("r").to_pylist():
                r = _triangle(np.concatenate([r, np.array(one).reshape(-1, wide)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["r"])

    held = materialize(rows.mapInArrow(factor, "r array<double>").withColumn("p", F.spark_partition_id()), "factors")
    while (count := held.count()) > FAN:
        dealt = held.repartition(max(1, count // FAN), F.col("p") % max(1, count // FAN)).select("r")
        old, held = held, materialize(dealt.mapInArrow(join, "r array<double>").withColumn("p", F.spark_partition_id()), "factors")
        discard(old)
    got = [np.array(r.r).reshape(-1, wide) for r in held.orderBy("p").collect()]  # at most FAN
    discard(held)
    return _triangle(np.concatenate(got))


def _returned(rows: DataFrame, m: np.ndarray, inverse: np.ndarray, columns: int, sparse: bool) -> np.ndarray:
    """Transposed rows times their orthogonal factor (columns by directions): summed in tasks, then by cell."""

    def products(batches):
        total = np.zeros((columns, inverse.shape[1]))
        for b in _blocks(batches, columns, sparse):
            b.back(total, b.times(m) @ inverse)
        flat = total.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["cell", "v"])

    found = rows.mapInArrow(products, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(columns * inverse.shape[1])
    out[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    return out.reshape(columns, -1)


@dataclass(frozen=True)
class TruncatedSVD(Config):
    """Rows are not centred. The driver holds columns by (n_components + oversamples) numbers, which is checked."""

    n_components: int = 2
    oversamples: int = 10
    max_iter: int = 50
    tol: float = 1e-9
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str]) -> "TruncatedSVDModel":
        """Over feature columns; null or NaN values are an error."""
        require(df, features)
        x = [number(f) for f in features]
        bad = df.agg(F.sum(sum(((c.isNull() | F.isnan(c)).cast("long") for c in x), F.lit(0).cast("long")))).first()[0]
        if bad:
            raise InvalidParameterError(f"{bad} null or NaN values; impute them first")
        return self._fit(df.select(F.array(*x).alias("v")), len(features), False, tuple(features))

    def fit_arrays(self, df: DataFrame, column: str) -> "TruncatedSVDModel":
        """Over one column of arrays of one length; null arrays, null or NaN elements and other lengths are errors."""
        require(df, [column])
        v = F.col(f"`{column}`")
        low, high, bad = df.agg(F.min(F.size(v)), F.max(F.size(v)), F.sum((v.isNull() | F.exists(v, lambda e: e.isNull() | F.isnan(e))).cast("long"))).first()
        if bad or low != high:
            raise InvalidParameterError("arrays need one length and no null or NaN elements")
        return self._fit(df.select(v.cast("array<double>").alias("v")), low or 0, False, (column,))

    def fit_sparse(self, matrix: Sparse) -> "TruncatedSVDModel":
        """Over the rows of a sparse matrix; the model transforms `row_views`."""
        views = matrix.row_views().select(F.col("indices").cast("array<int>").alias("c"), F.col("values").cast("array<double>").alias("v"))
        return self._fit(views, matrix.n_cols, True, ("indices", "values"))

    def _fit(self, rows: DataFrame, columns: int, sparse: bool, source: tuple[str, ...]) -> "TruncatedSVDModel":
        if self.n_components < 1 or self.oversamples < 0 or self.max_iter < 1 or self.tol < 0:
            raise InvalidParameterError("n_components and max_iter >= 1, oversamples and tol >= 0 are needed")
        wide = columns if columns <= ALL else min(columns, self.n_components + self.oversamples)
        if self.n_components > columns:
            raise InvalidParameterError("more components than columns")
        if columns * wide > CELLS:
            raise InvalidParameterError("too many columns and components for the driver")
        held = materialize(rows, "svd")
        try:
            if held.isEmpty():
                raise EmptyInputError("no rows")
            m = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((columns, wide)))[0]
            before, steps = None, 0
            for steps in range(1, self.max_iter + 1):
                _, s, v = np.linalg.svd(_triangles(held, m, columns, sparse))
                kept = s > s[0] * 1e-12 if s[0] > 0 else s < 0
                if not kept.any():
                    values, m = np.zeros(wide), m
                    break
                b = _returned(held, m, v[: len(s)][kept].T / s[kept], columns, sparse)  # columns by directions
                m, values, _ = np.linalg.svd(b, full_matrices=False)
                if before is not None and len(before) == len(values) and np.abs(values - before)[: self.n_components].max() <= self.tol * values[0]:
                    break
                before = values
        finally:
            discard(held)
        parts = np.zeros((self.n_components, columns))
        found = min(self.n_components, m.shape[1])
        parts[:found] = m.T[:found]
        sign = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])
        parts *= np.where(sign == 0, 1, sign)[:, None]
        values = np.concatenate([values, np.zeros(self.n_components)])[: self.n_components]
        return TruncatedSVDModel(source, sparse, columns, tuple(map(tuple, parts.tolist())), tuple(values.tolist()), steps)


@dataclass(frozen=True)
class TruncatedSVDModel:
    """components: directions of the columns, one a row, the largest loading positive."""

    source: tuple[str, ...]
    sparse: bool
    columns: int
    components: tuple[tuple[float, ...], ...]
    singular_values: tuple[float, ...]
    iterations: int

    def transform(self, df: DataFrame, output: str = "components") -> DataFrame:
        """Adds the row's products with the components as an array, in Arrow batches; for sparse models rows have `indices` and `values`."""
        require(df, self.source)
        m, columns, sparse = np.array(self.components).T, self.columns, self.sparse

        @F.pandas_udf("array<double>")
        def project(v: pd.Series, c: pd.Series) -> pd.Series:
            if not sparse:
                return pd.Series(list(np.stack(v.to_list()).astype(float).reshape(len(v), columns) @ m))
            at = np.repeat(np.arange(len(v)), [len(x) for x in v])
            block = _Block(len(v), at, np.concatenate([np.asarray(x, np.int64) for x in c]), np.concatenate([np.asarray(x, float) for x in v]))
            return pd.Series(list(block.times(m)))

        if sparse:
            return df.withColumn(output, project(F.col("values").cast("array<double>"), F.col("indices").cast("array<int>")))
        v = F.col(f"`{self.source[0]}`").cast("array<double>") if len(self.source) == 1 and dict(df.dtypes)[self.source[0]].startswith("array") else F.array(*[number(f) for f in self.source])
        return df.withColumn(output, project(v, F.lit(0)))
