"""Metrics as aggregations. Functions named *_table return DataFrames; the others the number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import InvalidParameterError
from ..plans.frame import number

AVERAGES = ("binary", "micro", "macro", "weighted")


def _one(df: DataFrame, value: Column, *cols: str) -> float:
    got = df.agg(F.count("*").alias("n"), value.alias("v")).first()
    if not got.n:
        raise ValueError("empty input")
    return float(got.v)


def _share(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return _one(df, F.avg((number(label) == number(prediction)).cast("double")))


def class_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class of labels or predictions: tp, fp, fn, support. Pairs are counted before anything is exchanged."""
    pairs = df.groupBy(number(label).alias("t"), number(prediction).alias("p")).agg(F.count("*").alias("n"))
    both = pairs.select(F.explode(F.when(F.col("t") == F.col("p"), F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).otherwise(
        F.array(
            F.struct(F.col("t").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn")),
            F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn")),
        )
    )).alias("x")).select("x.*")
    return both.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum(F.col("tp") + F.col("fn")).alias("support"))


def prf_table(df: DataFrame, average: str = "binary", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: precision, recall, f1. Binary looks at class 1 alone; macro divides by all classes of labels or predictions; another name counts as binary."""
    c = class_counts(df, label, prediction)
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.select("*", p.alias("p"), r.alias("r")).withColumn("f", _share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    if average == "macro":
        return c.agg(*[F.coalesce(F.avg(x), F.lit(0.0)).alias(n) for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])
    if average == "weighted":
        return c.agg(*[_share(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(n) for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])
    if average == "micro":
        p, r = _share(F.sum("tp"), F.sum("tp") + F.sum("fp")), _share(F.sum("tp"), F.sum("tp") + F.sum("fn"))
        return c.agg(p.alias("precision"), r.alias("recall")).withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    one = c.where(F.col("class") == 1.0)
    return one.agg(*[F.coalesce(F.max(x), F.lit(0.0)).alias(n) for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])


def _prf(df, what, average, label, prediction) -> float:
    if df.isEmpty():
        raise ValueError("empty input")
    return float(prf_table(df, average, label, prediction).first()[what])


def precision(df: DataFrame, average: str = "binary", label: str = "label", prediction: str = "prediction") -> float:
    return _prf(df, "precision", average, label, prediction)


def recall(df: DataFrame, average: str = "binary", label: str = "label", prediction: str = "prediction") -> float:
    return _prf(df, "recall", average, label, prediction)


def f1(df: DataFrame, average: str = "binary", label: str = "label", prediction: str = "prediction") -> float:
    return _prf(df, "f1", average, label, prediction)


def confusion_table(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long form over all classes: true_class, predicted_class, n (0 where none). The grid has a cell a pair of classes."""
    pairs = df.groupBy(number(label).alias("true_class"), number(prediction).alias("predicted_class")).agg(F.count("*").alias("n"))
    classes = pairs.select(F.col("true_class").alias("c")).union(pairs.select("predicted_class")).distinct()
    grid = classes.select(F.col("c").alias("true_class")).crossJoin(classes.select(F.col("c").alias("predicted_class")))
    return grid.join(pairs, ["true_class", "predicted_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> tuple[tuple[float, ...], list[list[int]]]:
    """Sorted classes, and counts by true class and predicted class."""
    rows = confusion_table(df, label, prediction).collect()
    if not rows:
        raise ValueError("empty input")
    classes = tuple(sorted({r.true_class for r in rows}))
    at = {c: i for i, c in enumerate(classes)}
    out = [[0] * len(classes) for _ in classes]
    for r in rows:
        out[at[r.true_class]][at[r.predicted_class]] = r.n
    return classes, out


def roc_auc_table(df: DataFrame, label: str = "label", score: str = "score", buckets: int = 256) -> DataFrame:
    """One row: roc_auc of class 1 against the rest, ties as one point; 0 with one class only.

    Scores are counted, then summed in ranges of scores: a running sum inside each range and over the ranges (a few hundred
    rows), so no task holds all distinct scores.
    """
    counts = df.groupBy(number(score).alias("s")).agg(F.sum((number(label) == 1.0).cast("long")).alias("pos"), F.sum((number(label) != 1.0).cast("long")).alias("neg"))
    ranged = counts.repartitionByRange(buckets, "s").withColumn("b", F.spark_partition_id())
    inside = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    # Pairs inside a range are counted there; what lies below a range counts for all of its positives.
    part = ranged.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).groupBy("b").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("own"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    order = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    total = part.withColumn("under", F.coalesce(F.sum("neg").over(order), F.lit(0)))
    return total.agg(_share(F.sum(F.col("own") + F.col("pos") * F.col("under")), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> float:
    if df.isEmpty():
        raise ValueError("empty input")
    return float(roc_auc_table(df, label, score).first().roc_auc)


def _residual(label, prediction):
    return number(label) - number(prediction)


def mae(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return _one(df, F.avg(F.abs(_residual(label, prediction))))


def mse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return _one(df, F.avg(_residual(label, prediction) ** 2))


def rmse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return mse(df, label, prediction) ** 0.5


def r2_column(label: str = "label", prediction: str = "prediction") -> Column:
    """Aggregate: 1 - residual over total sum of squares; a constant label gives 1 if all is right, else 0."""
    left, total = F.sum(_residual(label, prediction) ** 2), F.var_pop(number(label)) * F.count("*")
    return F.when(total == 0, (left == 0).cast("double")).otherwise(1 - F.try_divide(left, total))


def r2(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return _one(df, r2_column(label, prediction))


def regression_table(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mae, mse, rmse, r2, in one aggregation."""
    d = _residual(label, prediction)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d**2).alias("mse"), F.sqrt(F.avg(d**2)).alias("rmse"), r2_column(label, prediction).alias("r2"))


SCORERS = {"accuracy": accuracy, "precision": precision, "recall": recall, "f1": f1, "r2": r2, "mae": mae, "mse": mse, "rmse": rmse, "neg_mse": lambda df, label="label", prediction="prediction": -mse(df, label, prediction)}


def scorer(name):
    """A scorer by name, or the callable (df, label, prediction) -> float itself."""
    if callable(name):
        return name
    if name not in SCORERS:
        raise InvalidParameterError(f"unknown scorer {name!r}")
    return SCORERS[name]
