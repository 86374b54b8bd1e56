"""Generators as column expressions, and loaders of classic tables from files that the caller names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import DimensionMismatchError, InvalidParameterError
from ..functions.rng import normal, uniform
from ..plans.frame import partitions

#: Column names and numbers of rows of the classic tables.
IRIS = ("sepal_length", "sepal_width", "petal_length", "petal_width")
DIABETES = ("age", "sex", "bmi", "bp", "s1", "s2", "s3", "s4", "s5", "s6")
WINE = ("alcohol", "malic_acid", "ash", "alcalinity_of_ash", "magnesium", "total_phenols", "flavanoids", "nonflavanoid_phenols", "proanthocyanins", "color_intensity", "hue", "od280_od315", "proline")
COLUMNS = {"iris": IRIS, "diabetes": DIABETES, "wine": WINE}
ROWS = {"iris": 150, "diabetes": 442, "wine": 178}


def _load(spark: SparkSession, path: str, name: str) -> DataFrame:
    columns, rows = COLUMNS[name], ROWS[name]
    schema = ", ".join(f"{c} double" for c in (*columns, "label"))
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    if df.count() != rows:
        raise DimensionMismatchError(f"{path} doesn't have {rows} rows")
    return df


def load_iris(spark: SparkSession, path: str) -> DataFrame:
    """150 rows of four measures and a class, from a CSV file with a header."""
    return _load(spark, path, "iris")


def load_diabetes(spark: SparkSession, path: str) -> DataFrame:
    """442 rows of ten standardised features and a target, from a CSV file with a header."""
    return _load(spark, path, "diabetes")


def load_wine(spark: SparkSession, path: str) -> DataFrame:
    """178 rows of thirteen measures and a class, from a CSV file with a header."""
    return _load(spark, path, "wine")


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(partitions(spark), -(-n // 10_000)))).withColumnRenamed("id", "row_id")


def make_blobs(spark: SparkSession, n_samples: int = 100, n_features: int = 2, n_clusters: int = 3, std: float = 1.0, seed: int = 0) -> DataFrame:
    """Row i belongs to cluster i % n_clusters: a center in [-10, 10] and normal noise. row_id, f0.., label."""
    if n_samples <= 0 or n_features <= 0 or n_clusters <= 0 or std < 0:
        raise InvalidParameterError("sizes must be positive, std not negative")
    c = F.col("row_id") % n_clusters
    cols = [(uniform(seed, F.lit("center"), c, F.lit(j)) * 20 - 10 + F.lit(float(std)) * normal(seed, "row_id", F.lit(j))).alias(f"f{j}") for j in range(n_features)]
    return _rows(spark, n_samples).select("row_id", *cols, c.cast("double").alias("label"))


def make_classification(spark: SparkSession, n_samples: int = 100, n_features: int = 20, n_informative: int = 2, n_redundant: int = 2, n_classes: int = 2, flip_y: float = 0.01, class_sep: float = 1.0, seed: int = 0) -> DataFrame:
    """Informative features, random mixes of them, noise; labels are equal-width bins of the informative features' sum, some flipped."""
    if n_samples <= 0 or n_features <= 0 or n_informative <= 0 or n_redundant < 0 or n_classes < 2 or n_informative + n_redundant > n_features or not 0 <= flip_y <= 1:
        raise InvalidParameterError("sizes don't fit")
    d = _rows(spark, n_samples).select("row_id", *[(normal(seed, "row_id", F.lit(j)) * F.lit(float(class_sep))).alias(f"f{j}") for j in range(n_informative)])
    total = sum((F.col(f"f{j}") for j in range(n_informative)), F.lit(0.0))
    low, high = d.agg(F.min(total), F.max(total)).first()
    width = (high - low) / n_classes or 1.0
    label = F.least(F.floor((total - F.lit(low)) / F.lit(width)), F.lit(n_classes - 1)).cast("double")
    mixed = [sum((F.col(f"f{i}") * normal(seed, F.lit("mix"), F.lit(r), F.lit(i)) for i in range(n_informative)), F.lit(0.0)).alias(f"f{n_informative + r}") for r in range(n_redundant)]
    noise = [normal(seed, "row_id", F.lit(j)).alias(f"f{j}") for j in range(n_informative + n_redundant, n_features)]
    flipped = F.when(uniform(seed, F.lit("flip"), "row_id") < flip_y, F.floor(uniform(seed, F.lit("class"), "row_id") * n_classes).cast("double")).otherwise(label)
    return d.select("row_id", *[f"f{j}" for j in range(n_informative)], *mixed, *noise, flipped.alias("label"))


def make_regression(spark: SparkSession, n_samples: int = 100, n_features: int = 100, n_informative: int = 10, noise: float = 0.0, bias: float = 0.0, seed: int = 0) -> DataFrame:
    """Normal features; the label is a random combination of the first n_informative, plus bias and noise."""
    if n_samples <= 0 or n_features <= 0 or not 0 < n_informative <= n_features or noise < 0:
        raise InvalidParameterError("sizes don't fit")
    d = _rows(spark, n_samples).select("row_id", *[normal(seed, "row_id", F.lit(j)).alias(f"f{j}") for j in range(n_features)])
    y = sum((F.col(f"f{j}") * normal(seed, F.lit("coef"), F.lit(j)) for j in range(n_informative)), F.lit(float(bias)))
    return d.withColumn("label", y + F.lit(float(noise)) * normal(seed, F.lit("noise"), "row_id"))
