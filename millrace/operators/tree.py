"""Decision trees by exact CART."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Config, InvalidParameterError, require
from ..plans.cart import Node, Params, grow, importances
from ..plans.flat import array_of, value_of
from ..plans.frame import checked, number
from . import metrics


#: Classes up to which a classifier is fitted.
MOST_CLASSES = 4096


def validated(criterion: str, known: tuple[str, ...], split: int, leaf: int) -> None:
    if criterion not in known:
        raise InvalidParameterError(f"criterion must be one of {known}")
    if split < 2 or leaf < 1:
        raise InvalidParameterError("min_samples_split must be 2 at least, min_samples_leaf 1")


def feature(name: str) -> Column:
    """A feature as a double; null counts as NaN, which lies above all values and goes right."""
    return F.coalesce(number(name), F.lit(float("nan")))


def class_rows(df: DataFrame, features, label: str) -> tuple[tuple[float, ...], DataFrame]:
    """Sorted classes, and rows with the label's number as y. More than MOST_CLASSES are an error: the model holds a number a class and node."""
    classes = tuple(sorted(r[0] for r in df.select(number(label)).distinct().limit(MOST_CLASSES + 1).collect()))
    if len(classes) > MOST_CLASSES:
        raise InvalidParameterError(f"more than {MOST_CLASSES} classes; is the label continuous?")
    y = (F.array_position(F.array(*[F.lit(c) for c in classes]), number(label)) - 1).cast("double")
    return classes, df.select(*[feature(f).alias(f) for f in features], y.alias("y"))


def pre_aggregated(rows: DataFrame, features) -> DataFrame:
    """Equal rows once, with their number as weight."""
    return rows.groupBy(*[F.col(f"`{f}`") for f in features], "y").agg(F.count("*").cast("double").alias("w"))


@dataclass(frozen=True)
class DecisionTreeClassifier(Config):
    max_depth: int = -1
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    criterion: str = "gini"
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> "TreeClassifierModel":
        validated(self.criterion, ("gini", "entropy"), self.min_samples_split, self.min_samples_leaf)
        require(df, features)
        checked(df, [], label)
        classes, rows = class_rows(df, features, label)
        params = Params(self.max_depth, self.min_samples_split, self.min_samples_leaf, self.criterion, classes)
        root = grow(pre_aggregated(rows, features).withColumn("tree", F.lit(0)), list(features), params)[0]
        return TreeClassifierModel(tuple(features), classes, root)


@dataclass(frozen=True)
class TreeClassifierModel:
    features: tuple[str, ...]
    classes: tuple[float, ...]
    root: Node

    @property
    def feature_importances(self) -> tuple[float, ...]:
        return tuple(importances(self.root, len(self.features)))

    def column(self) -> Column:
        return value_of([self.root], list(self.features))

    def probability(self) -> Column:
        return array_of([self.root], list(self.features), lambda n: n.proba)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, self.column())

    def predict_probabilities(self, df: DataFrame, output: str = "probability") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, self.probability())

    def score(self, df: DataFrame, label: str = "label") -> float:
        return metrics.accuracy(self.predict(df, "_p"), label, "_p")


@dataclass(frozen=True)
class DecisionTreeRegressor(Config):
    max_depth: int = -1
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    criterion: str = "mse"
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> "TreeRegressorModel":
        validated(self.criterion, ("mse",), self.min_samples_split, self.min_samples_leaf)
        require(df, features)
        checked(df, [], label)
        rows = df.select(*[feature(f).alias(f) for f in features], number(label).alias("y"))
        params = Params(self.max_depth, self.min_samples_split, self.min_samples_leaf, "mse")
        root = grow(pre_aggregated(rows, features).withColumn("tree", F.lit(0)), list(features), params)[0]
        return TreeRegressorModel(tuple(features), root)


@dataclass(frozen=True)
class TreeRegressorModel:
    features: tuple[str, ...]
    root: Node

    @property
    def feature_importances(self) -> tuple[float, ...]:
        return tuple(importances(self.root, len(self.features)))

    def column(self) -> Column:
        return value_of([self.root], list(self.features))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, self.column())

    def score(self, df: DataFrame, label: str = "label") -> float:
        return metrics.r2(self.predict(df, "_p"), label, "_p")
