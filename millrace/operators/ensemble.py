"""Random forests, all trees grown in the same plans, and gradient boosting."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5
from math import isqrt, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Config, InvalidParameterError, require
from ..functions.rng import key, uniform
from ..plans.cart import Node, Params, grow, importances
from ..plans.flat import array_of, value_of
from ..plans.frame import checked, number, numbered
from ..plans.scratch import discard, materialize
from . import metrics
from .tree import class_rows, feature, validated


def bootstrap(rows: DataFrame, n: int, trees: int, seed: int) -> DataFrame:
    """n draws with replacement for each tree: `rows` (with i from 0 to n - 1) joined with how often each was drawn, as w."""
    draws = rows.sparkSession.range(0, n * trees).select((F.col("id") % trees).cast("int").alias("tree"), F.floor(uniform(seed, "id") * n).cast("long").alias("i"))
    return rows.join(draws.groupBy("tree", "i").agg(F.count("*").cast("double").alias("w")), "i").drop("i")


def _subsets(p: int, size: int, trees: int, seed: int) -> dict[int, list[int]]:
    """A subset of the features for every tree: those of least digest."""
    digest = lambda t, f: md5(f"{seed}:feature:{t}:{f}".encode()).hexdigest()
    return {t: sorted(sorted(range(p), key=lambda f: digest(t, f))[:size]) for t in range(trees)}


def _placed(rows: DataFrame, features, seed: int) -> DataFrame:
    """Rows with numbers i in an order that depends on their values and the seed alone; equal rows are interchangeable."""
    values = [F.col(f"`{c}`") for c in (*features, "y")]
    return numbered(rows, [key(seed, *values), *values], "i")


@dataclass(frozen=True)
class _Forest(Config):
    n_trees: int = 100
    max_depth: int = -1
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    seed: int = 0
    n_jobs: int = 1

    def _grow(self, rows: DataFrame, features, n: int, size: int, params: Params) -> tuple[Node, ...]:
        # Rows of equal values drawn by a tree are one row with a weight.
        placed = _placed(rows, features, self.seed)
        drawn = bootstrap(placed, n, self.n_trees, self.seed).groupBy("tree", *[F.col(f"`{f}`") for f in features], "y").agg(F.sum("w").alias("w"))
        trees = grow(drawn, list(features), params, _subsets(len(features), size, self.n_trees, self.seed))
        discard(placed)
        return tuple(trees[t] for t in range(self.n_trees))

    def _valid(self):
        if self.n_trees < 1:
            raise InvalidParameterError("n_trees must be positive")


def _mean_importances(trees, p: int) -> tuple[float, ...]:
    total = [sum(x) for x in zip(*[importances(t, p) for t in trees])]
    whole = sum(total)
    return tuple(x / whole for x in total) if whole > 0 else tuple(total)


@dataclass(frozen=True)
class RandomForestClassifier(_Forest):
    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> "ForestClassifierModel":
        self._valid()
        validated("gini", ("gini",), self.min_samples_split, self.min_samples_leaf)
        require(df, features)
        n = checked(df, [], label)
        classes, rows = class_rows(df, features, label)
        params = Params(self.max_depth, self.min_samples_split, self.min_samples_leaf, "gini", classes)
        return ForestClassifierModel(tuple(features), classes, self._grow(rows, features, n, max(1, isqrt(len(features))), params))


@dataclass(frozen=True)
class ForestClassifierModel:
    features: tuple[str, ...]
    classes: tuple[float, ...]
    trees: tuple[Node, ...]

    @property
    def feature_importances(self) -> tuple[float, ...]:
        return _mean_importances(self.trees, len(self.features))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """The class with most votes, the smallest of equals."""
        require(df, self.features)
        votes = array_of(list(self.trees), list(self.features), lambda n: [float(n.value == c) for c in self.classes])
        best = F.array_position("_c", F.array_max("_c")) - 1
        return df.withColumn("_c", votes).withColumn(output, F.get(F.array(*[F.lit(c) for c in self.classes]), best.cast("int"))).drop("_c")

    def predict_probabilities(self, df: DataFrame, output: str = "probability") -> DataFrame:
        """Mean of the trees' class shares."""
        require(df, self.features)
        total = array_of(list(self.trees), list(self.features), lambda n: n.proba)
        return df.withColumn(output, F.transform(total, lambda x: x / len(self.trees)))

    def score(self, df: DataFrame, label: str = "label") -> float:
        return metrics.accuracy(self.predict(df, "_p"), label, "_p")


@dataclass(frozen=True)
class RandomForestRegressor(_Forest):
    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> "ForestRegressorModel":
        self._valid()
        validated("mse", ("mse",), self.min_samples_split, self.min_samples_leaf)
        require(df, features)
        n = checked(df, [], label)
        rows = df.select(*[feature(f).alias(f) for f in features], number(label).alias("y"))
        params = Params(self.max_depth, self.min_samples_split, self.min_samples_leaf, "mse")
        return ForestRegressorModel(tuple(features), self._grow(rows, features, n, max(1, len(features) // 3), params))


@dataclass(frozen=True)
class ForestRegressorModel:
    features: tuple[str, ...]
    trees: tuple[Node, ...]

    @property
    def feature_importances(self) -> tuple[float, ...]:
        return _mean_importances(self.trees, len(self.features))

    def column(self) -> Column:
        return value_of(list(self.trees), list(self.features)) / len(self.trees)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, self.column())

    def score(self, df: DataFrame, label: str = "label") -> float:
        return metrics.r2(self.predict(df, "_p"), label, "_p")


@dataclass(frozen=True)
class _Boosting(Config):
    n_trees: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    min_samples_leaf: int = 1
    seed: int = 0
    subsample: float = 1.0

    def _valid(self):
        if self.n_trees < 1 or self.learning_rate <= 0 or not 0 < self.subsample <= 1:
            raise InvalidParameterError("n_trees >= 1, learning_rate > 0 and 0 < subsample <= 1 are needed")
        validated("mse", ("mse",), 2, self.min_samples_leaf)

    def _boost(self, rows: DataFrame, features, n: int, residual: Column) -> tuple[Node, ...]:
        """rows: features, y, raw. Each round fits a tree to the residuals and moves raw; written each round, so lineage stays short."""
        params, trees = Params(self.max_depth, 2, self.min_samples_leaf, "mse"), []
        names = list(features)
        placed = _placed(rows, names, self.seed) if self.subsample < 1 else None
        state = materialize(rows if placed is None else placed, "boost")
        if placed is not None:
            discard(placed)
        for t in range(self.n_trees):
            part, drawn = state.withColumn("r", residual), None
            if self.subsample < 1:
                drawn = numbered(part, [key(self.seed + t, "i"), F.col("i")], "place")
                part = drawn.where(F.col("place") < max(1, int(n * self.subsample)))
            fit = part.select(*[F.col(f"`{f}`") for f in names], F.col("r").alias("y")).groupBy(*[F.col(f"`{f}`") for f in names], "y").agg(F.count("*").cast("double").alias("w"))
            root = grow(fit.withColumn("tree", F.lit(0)), names, params)[0]
            if drawn is not None:
                discard(drawn)
            trees.append(root)
            if t + 1 < self.n_trees:
                step = value_of([root], names)
                old, state = state, materialize(state.withColumn("raw", F.col("raw") + F.lit(self.learning_rate) * step), "boost")
                discard(old)
        discard(state)
        return tuple(trees)


def _raw(features, trees, rate: float, start: float) -> Column:
    return F.lit(start) + F.lit(rate) * value_of(list(trees), list(features))


@dataclass(frozen=True)
class GradientBoostingRegressor(_Boosting):
    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> "BoostedRegressorModel":
        self._valid()
        require(df, features)
        n = checked(df, [], label)
        start = float(df.agg(F.avg(number(label))).first()[0])
        rows = df.select(*[feature(f).alias(f) for f in features], number(label).alias("y"), F.lit(start).alias("raw"))
        return BoostedRegressorModel(tuple(features), self._boost(rows, features, n, F.col("y") - F.col("raw")), self.learning_rate, start)


@dataclass(frozen=True)
class BoostedRegressorModel:
    features: tuple[str, ...]
    trees: tuple[Node, ...]
    learning_rate: float
    start: float

    def column(self) -> Column:
        return _raw(self.features, self.trees, self.learning_rate, self.start)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, self.column())

    def score(self, df: DataFrame, label: str = "label") -> float:
        return metrics.r2(self.predict(df, "_p"), label, "_p")


@dataclass(frozen=True)
class GradientBoostingClassifier(_Boosting):
    """Two classes; leaves are mean residuals of the probabilities."""

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> "BoostedClassifierModel":
        self._valid()
        require(df, features)
        n = checked(df, [], label)
        classes, rows = class_rows(df, features, label)
        if len(classes) != 2:
            raise InvalidParameterError("exactly two classes are needed")
        share = min(1 - 1e-10, max(1e-10, float(rows.agg(F.avg("y")).first()[0])))
        start = log(share / (1 - share))
        rows = rows.withColumn("raw", F.lit(start))
        return BoostedClassifierModel(tuple(features), classes, self._boost(rows, features, n, F.col("y") - 1.0 / (1.0 + F.exp(-F.col("raw")))), self.learning_rate, start)


@dataclass(frozen=True)
class BoostedClassifierModel:
    features: tuple[str, ...]
    classes: tuple[float, ...]
    trees: tuple[Node, ...]
    learning_rate: float
    start: float

    def column(self) -> Column:
        """Probability of the second class."""
        return 1.0 / (1.0 + F.exp(-_raw(self.features, self.trees, self.learning_rate, self.start)))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, F.when(self.column() >= 0.5, self.classes[1]).otherwise(self.classes[0]))

    def predict_probabilities(self, df: DataFrame, output: str = "probability") -> DataFrame:
        require(df, self.features)
        return df.withColumn("_p1", self.column()).withColumn(output, F.array(1.0 - F.col("_p1"), F.col("_p1"))).drop("_p1")

    def score(self, df: DataFrame, label: str = "label") -> float:
        return metrics.accuracy(self.predict(df, "_p"), label, "_p")
