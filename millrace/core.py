"""Errors and protocols of the library: configurations have fit(), models have predict() or transform()."""

from __future__ import annotations

from dataclasses import replace
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame


class DimensionMismatchError(ValueError):
    """Columns that a model needs are missing, or lengths differ."""


class SingularMatrixError(ValueError):
    """A linear system has no unique solution."""


class ConvergenceWarning(UserWarning):
    """An iteration stopped at its limit."""


class EmptyInputError(ValueError):
    """No rows or no columns."""


class InvalidParameterError(ValueError):
    """A parameter is outside its range."""


@runtime_checkable
class Estimator(Protocol):
    def fit(self, df: DataFrame, features: list[str], label: str) -> Any: ...


@runtime_checkable
class Predictor(Protocol):
    def predict(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Classifier(Protocol):
    def predict(self, df: DataFrame) -> DataFrame: ...

    def predict_probabilities(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Transformer(Protocol):
    def fit(self, df: DataFrame, features: list[str]) -> Any: ...


@runtime_checkable
class FittedTransformer(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class FitTransformer(Protocol):
    def fit_transform(self, df: DataFrame, features: list[str]) -> DataFrame: ...


@runtime_checkable
class SupervisedTransformer(Protocol):
    def fit(self, df: DataFrame, features: list[str], label: str) -> Any: ...


@runtime_checkable
class Scorer(Protocol):
    def score(self, df: DataFrame, label: str) -> float: ...


@runtime_checkable
class Cloneable(Protocol):
    def clone(self) -> Any: ...


@runtime_checkable
class HasCoefficients(Protocol):
    @property
    def coefficients(self) -> tuple[float, ...]: ...


@runtime_checkable
class HasFeatureImportances(Protocol):
    @property
    def feature_importances(self) -> tuple[float, ...]: ...


@runtime_checkable
class HasClasses(Protocol):
    @property
    def classes(self) -> tuple[float, ...]: ...


@runtime_checkable
class ParamSetter(Protocol):
    def set_params(self, **params: Any) -> Any: ...


class Config:
    """What all configurations share: copies with other parameters, and fit followed by transform."""

    def clone(self):
        return replace(self)

    def set_params(self, **params):
        """A copy with these parameters; unknown names are an error."""
        known = set(self.__dataclass_fields__)
        if unknown := set(params) - known:
            raise InvalidParameterError(f"unknown parameters {sorted(unknown)}")
        return replace(self, **params)


class FitTransformMixin:
    def fit_transform(self, df: DataFrame, features: list[str]) -> DataFrame:
        return self.fit(df, features).transform(df)


def require(df: DataFrame, columns) -> None:
    """Raises unless df has all columns."""
    if not columns:
        raise EmptyInputError("no feature columns")
    have = set(df.columns)
    if missing := [c for c in columns if c not in have]:
        raise DimensionMismatchError(f"missing columns {missing}")
