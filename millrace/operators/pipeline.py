"""Transformers followed by an estimator, fitted in order; predictions collapse to one projection."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame

from ..core import InvalidParameterError
from . import metrics


@dataclass(frozen=True)
class Step:
    name: str
    transformer: Any = None
    estimator: Any = None


def transform_step(name: str, transformer) -> Step:
    return Step(name, transformer=transformer)


def estimator_step(name: str, estimator) -> Step:
    return Step(name, estimator=estimator)


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...]

    def __init__(self, *steps: Step):
        object.__setattr__(self, "steps", tuple(steps))

    def set_params(self, **params):
        """Parameters as step__name."""
        steps = list(self.steps)
        for name, value in params.items():
            step, _, inner = name.partition("__")
            at = next((i for i, s in enumerate(steps) if s.name == step), None)
            if at is None or not inner:
                raise InvalidParameterError(f"no parameter {name!r}")
            kind = "transformer" if steps[at].transformer is not None else "estimator"
            steps[at] = replace(steps[at], **{kind: getattr(steps[at], kind).set_params(**{inner: value})})
        return Pipeline(*steps)

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> "FittedPipeline":
        if not self.steps or self.steps[-1].estimator is None or any(s.transformer is None for s in self.steps[:-1]):
            raise InvalidParameterError("transformers first and an estimator last are needed")
        fitted, names = [], list(features)
        for s in self.steps[:-1]:
            model = s.transformer.fit(df, names)
            df = model.transform(df)
            names = list(getattr(model, "outputs", names))
            fitted.append(model)
        return FittedPipeline(tuple(fitted), self.steps[-1].estimator.fit(df, names, label))


@dataclass(frozen=True)
class FittedPipeline:
    transformers: tuple[Any, ...]
    predictor: Any

    def transform(self, df: DataFrame) -> DataFrame:
        for t in self.transformers:
            df = t.transform(df)
        return df

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return self.predictor.predict(self.transform(df), output)

    def score(self, df: DataFrame, label: str = "label") -> float:
        """The predictor's own score, else R squared."""
        df = self.transform(df)
        return self.predictor.score(df, label) if hasattr(self.predictor, "score") else metrics.r2(self.predictor.predict(df, "_p"), label, "_p")
