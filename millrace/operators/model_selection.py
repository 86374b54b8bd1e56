"""Splits, cross-validation and grid search. Folds are a column; shuffles are orders by md5 of seed and row id."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import floor, isnan
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import EmptyInputError, InvalidParameterError, require
from ..functions.rng import key
from ..plans.frame import number, numbered
from ..plans.scratch import materialize
from ..plans.gram import Moments, moments
from . import metrics


def _count(df: DataFrame) -> int:
    if df is None:
        raise EmptyInputError("no input")
    n = df.count()
    if not n:
        raise EmptyInputError("no rows")
    return n


def train_test_split(df: DataFrame, test_size: float = 0.25, seed: int = 0, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Train and test rows; the test set has floor(n * test_size) rows, one at least: the tail of the shuffled order."""
    if not 0 < test_size < 1:
        raise InvalidParameterError("test_size must lie between 0 and 1")
    require(df, [row_id])
    n = _count(df)
    test = max(1, floor(n * test_size))
    placed = numbered(df, [key(seed, row_id), F.col(row_id)], "_place")
    return placed.where(F.col("_place") < n - test).drop("_place"), placed.where(F.col("_place") >= n - test).drop("_place")


def _fold(place, n, k):
    """Blocks of consecutive places, the first n % k of them one row longer."""
    size, more = F.floor(n / k), n % k
    head = more * (size + 1)
    return F.when(place < head, F.floor(place / (size + 1))).otherwise(more + F.floor((place - head) / F.greatest(size, F.lit(1)))).cast("int")


@dataclass(frozen=True)
class KFold:
    n_splits: int = 5
    shuffle: bool = False
    seed: int = 0

    def split(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        """df with `fold`: row i of the fold's test set, all others train."""
        n = _count(df)
        if self.n_splits < 2 or n < self.n_splits:
            raise InvalidParameterError("n_splits must be 2 at least and not above the number of rows")
        order = [key(self.seed, row_id), F.col(row_id)] if self.shuffle else [F.col(row_id)]
        return numbered(df, order, "_place").withColumn("fold", _fold(F.col("_place"), F.lit(n), F.lit(self.n_splits))).drop("_place")


@dataclass(frozen=True)
class StratifiedKFold:
    n_splits: int = 5
    shuffle: bool = False
    seed: int = 0

    def split(self, df: DataFrame, label: str = "label", row_id: str = "row_id") -> DataFrame:
        """df with `fold`: every class is cut into blocks of its own."""
        n = _count(df)
        if self.n_splits < 2 or n < self.n_splits:
            raise InvalidParameterError("n_splits must be 2 at least and not above the number of rows")
        sizes = df.groupBy(number(label).alias("_y")).agg(F.count("*").alias("_n")).collect()
        if min(r["_n"] for r in sizes) < self.n_splits:
            raise InvalidParameterError("a class has fewer rows than n_splits")
        order = [key(self.seed, row_id), F.col(row_id)] if self.shuffle else [F.col(row_id)]
        placed = numbered(df.withColumn("_y", number(label)), [F.col("_y"), *order], "_place")
        before, starts = 0, []
        for r in sorted(sizes, key=lambda r: r["_y"]):
            starts.append((r["_y"], before, r["_n"]))
            before += r["_n"]
        table = df.sparkSession.createDataFrame(starts, "_y double, _s long, _n long")  # a row a class
        return placed.join(F.broadcast(table), "_y").withColumn("fold", _fold(F.col("_place") - F.col("_s"), F.col("_n"), F.lit(self.n_splits))).drop("_y", "_s", "_n", "_place")


def folds(df: DataFrame, cv: int, seed: int, row_id: str) -> DataFrame:
    """Shuffled folds, written once."""
    return materialize(KFold(cv, True, seed).split(df, row_id), "folds")


def cross_val_score(estimator, df: DataFrame, features: list[str], label: str = "label", cv: int = 5, scorer="r2", seed: int = 0, row_id: str = "row_id", prepared: DataFrame | None = None) -> list[float]:
    """A score for each fold. Estimators that fit from moments share one aggregation over all folds: train is the whole less the fold."""
    if estimator is None or df is None or scorer is None:
        raise InvalidParameterError("an estimator, rows and a scorer are needed")
    score = metrics.scorer(scorer)
    data = folds(df, cv, seed, row_id) if prepared is None else prepared

    def one(i: int, model=None) -> float:
        model = model or estimator.fit(data.where(F.col("fold") != i), features, label)
        return float(score(model.predict(data.where(F.col("fold") == i), "_prediction"), label, "_prediction"))

    models: list[Any] = [None] * cv
    if hasattr(estimator, "from_moments"):
        parts = [moments(data.where(F.col("fold") == i), [*(number(c) for c in features), number(label)]) for i in range(cv)]
        models = [estimator.from_moments(_joined([m for j, m in enumerate(parts) if j != i]), features) for i in range(cv)]
    with ThreadPoolExecutor(min(4, cv)) as pool:
        return list(pool.map(one, range(cv), models))


def _joined(parts: list[Moments]) -> Moments:
    n = sum(m.n for m in parts)
    mean = sum(m.n * m.mean for m in parts) / n
    return Moments(n, mean, sum(m.scatter + m.n * np.outer(m.mean - mean, m.mean - mean) for m in parts))


@dataclass(frozen=True)
class CVResult:
    params: dict[str, Any]
    mean: float
    std: float
    scores: tuple[float, ...]


@dataclass(frozen=True)
class GridSearchResult:
    best_params: dict[str, Any]
    best_score: float
    best_model: Any
    results: tuple[CVResult, ...]

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return self.best_model.predict(df, output)


@dataclass(frozen=True)
class GridSearchCV:
    """Every parameter set of an explicit list by cross-validation; the best mean wins, the first of equals, and is fitted again on all rows."""

    estimator: Any
    param_grid: list[dict[str, Any]] = field(default_factory=list)
    cv: int = 5
    scorer: Any = "r2"
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], label: str = "label", row_id: str = "row_id") -> GridSearchResult:
        if self.estimator is None or not self.param_grid or self.scorer is None:
            raise InvalidParameterError("an estimator, a grid and a scorer are needed")
        if not hasattr(self.estimator, "set_params"):
            raise InvalidParameterError("the estimator can't be given parameters")
        data = folds(df, self.cv, self.seed, row_id)
        results = []
        for params in self.param_grid:
            scores = cross_val_score(self.estimator.set_params(**params), data, features, label, self.cv, self.scorer, self.seed, row_id, data)
            results.append(CVResult(dict(params), float(np.mean(scores)), float(np.std(scores)), tuple(scores)))
        able = [r for r in results if not isnan(r.mean)]
        if not able:
            raise InvalidParameterError("every score is NaN")
        best = max(able, key=lambda r: r.mean)
        return GridSearchResult(best.params, best.mean, self.estimator.set_params(**best.params).fit(df, features, label), tuple(results))
