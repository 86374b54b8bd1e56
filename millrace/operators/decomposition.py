"""Principal components from the scatter matrix of one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Config, DimensionMismatchError, FitTransformMixin, InvalidParameterError, require
from ..plans.frame import number
from ..plans.gram import dot, moments


@dataclass(frozen=True)
class PCA(Config, FitTransformMixin):
    n_components: int = 0

    def fit(self, df: DataFrame, features: list[str]) -> "PCAModel":
        """Components are rows of unit length, the largest loading of each positive; 0 or less: as many as rows and columns allow."""
        require(df, features)
        m = moments(df, [number(c) for c in features])
        most = min(m.n, len(features))
        if self.n_components > most:
            raise InvalidParameterError("more components than rows or columns")
        k = self.n_components if self.n_components > 0 else most
        values, vectors = np.linalg.eigh(m.scatter)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1].T
        signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
        vectors = vectors * np.where(signs == 0, 1, signs)[:, None]
        variance, total = values / max(m.n - 1, 1), values.sum()
        ratio = values[:k] / total if total > 0 else values[:k]
        return PCAModel(tuple(features), tuple(m.mean.tolist()), tuple(map(tuple, vectors[:k].tolist())), tuple(variance[:k].tolist()), tuple(ratio.tolist()), tuple(np.sqrt(values[:k]).tolist()))


@dataclass(frozen=True)
class PCAModel:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained_variance: tuple[float, ...]
    explained_variance_ratio: tuple[float, ...]
    singular_values: tuple[float, ...]

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(f"pc{i}" for i in range(len(self.components)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Centred projections pc0, pc1, ... in place of the features."""
        require(df, self.features)
        rest = [F.col(f"`{c}`") for c in df.columns if c not in self.features]
        return df.select(*rest, *[dot(self.features, c, -float(np.dot(self.mean, c))).alias(o) for o, c in zip(self.outputs, self.components)])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.outputs if c not in df.columns]:
            raise DimensionMismatchError(f"missing columns {missing}")
        rest = [F.col(f"`{c}`") for c in df.columns if c not in self.outputs]
        return df.select(*rest, *[dot(self.outputs, [c[j] for c in self.components], self.mean[j]).alias(f) for j, f in enumerate(self.features)])
