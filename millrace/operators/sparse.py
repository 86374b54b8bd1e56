"""Sparse matrices as rows (row, col, value) with dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import require


@dataclass(frozen=True)
class Sparse:
    n_rows: int
    n_cols: int
    entries: DataFrame

    @staticmethod
    def from_csr(spark: SparkSession, n_rows: int, n_cols: int, data, indices, indptr) -> "Sparse":
        """From compressed rows given as lists; lengths, order of row bounds and columns are checked."""
        data, indices, indptr = list(map(float, data)), list(indices), list(indptr)
        if n_rows < 0 or n_cols < 0 or len(indptr) != n_rows + 1 or len(data) != len(indices) or indptr[-1] != len(data) or indptr[0] != 0:
            raise ValueError("lengths don't fit the dimensions")
        if any(b < a for a, b in zip(indptr, indptr[1:])) or any(not 0 <= j < n_cols for j in indices):
            raise ValueError("row bounds or columns out of range")
        rows = [(i, indices[k], data[k]) for i in range(n_rows) for k in range(indptr[i], indptr[i + 1])]
        return Sparse(n_rows, n_cols, spark.createDataFrame(rows, "row long, col int, value double"))

    @staticmethod
    def from_row_views(df: DataFrame, n_rows: int, n_cols: int) -> "Sparse":
        """From rows (row, indices, values), as `row_views` gives them; rows that don't fit the dimensions fail the query."""
        require(df, ["row", "indices", "values"])
        fits = (F.size("indices") == F.size("values")) & F.col("row").between(0, n_rows - 1) & F.forall("indices", lambda j: j.between(0, n_cols - 1))
        e = F.when(fits, F.arrays_zip("indices", "values")).otherwise(F.raise_error(F.lit("a row doesn't fit the dimensions")))
        return Sparse(n_rows, n_cols, df.select(F.col("row").cast("long").alias("row"), F.inline(e).alias("col", "value")).select("row", F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")))

    @staticmethod
    def from_dense(df: DataFrame, features: list[str], row_id: str = "row_id", n_rows: int | None = None) -> "Sparse":
        """Non-zero values of the feature columns."""
        require(df, [*features, row_id])
        e = df.select(F.col(row_id).cast("long").alias("row"), F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in features])).alias("col", "value")).where("value <> 0")
        return Sparse(df.count() if n_rows is None else n_rows, len(features), e)

    def nnz(self) -> int:
        return self.entries.count()

    def density(self) -> float:
        cells = self.n_rows * self.n_cols
        return self.nnz() / cells if cells else 0.0

    def at(self, i: int, j: int) -> float:
        if not (0 <= i < self.n_rows and 0 <= j < self.n_cols):
            raise IndexError((i, j))
        return float(self.entries.where((F.col("row") == i) & (F.col("col") == j)).agg(F.coalesce(F.max("value"), F.lit(0.0))).first()[0])

    def transpose(self) -> "Sparse":
        return Sparse(self.n_cols, self.n_rows, self.entries.select(F.col("col").cast("long").alias("row"), F.col("row").cast("int").alias("col"), "value"))

    def to_dense(self) -> DataFrame:
        """One row a matrix row, zeros filled: row, c0, c1, ..."""
        grid = self.entries.sparkSession.range(0, self.n_rows).select(F.col("id").alias("row"))
        wide = self.entries.groupBy("row").agg(*[F.max(F.when(F.col("col") == j, F.col("value"))).alias(f"c{j}") for j in range(self.n_cols)]) if self.n_cols else self.entries.select("row").distinct()
        return grid.join(wide, "row", "left").fillna(0.0)

    def row_view(self, i: int) -> tuple[list[int], list[float]]:
        """Columns and values of one row."""
        if not 0 <= i < self.n_rows:
            raise IndexError(i)
        got = sorted((r.col, r.value) for r in self.entries.where(F.col("row") == i).select("col", "value").collect())
        return [c for c, _ in got], [v for _, v in got]

    def row_views(self) -> DataFrame:
        """(row, indices, values) of all rows with entries."""
        v = self.entries.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("e"))
        return v.select("row", F.col("e.col").alias("indices"), F.col("e.value").alias("values"))

    def mul_vec(self, x: DataFrame) -> DataFrame:
        """(row, y) of the product with x (col, x); rows without entries give 0."""
        part = self.entries.join(x.select("col", "x"), "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("y"))
        rows = self.entries.sparkSession.range(0, self.n_rows).select(F.col("id").alias("row"))
        return rows.join(part, "row", "left").select("row", F.coalesce("y", F.lit(0.0)).alias("y"))

    def scale(self, alpha: float) -> "Sparse":
        """Stored entries times alpha; zeros that arise stay stored."""
        return Sparse(self.n_rows, self.n_cols, self.entries.withColumn("value", F.col("value") * F.lit(float(alpha))))
