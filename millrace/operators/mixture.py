"""Mixtures of Gaussians by expectation-maximisation: a step is one aggregation over the rows."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from math import log, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Config, ConvergenceWarning, InvalidParameterError, SingularMatrixError, require
from ..plans.frame import checked, number
from ..plans.scratch import discard, materialize
from .cluster import KMeans

#: Numbers that a step may send to the driver, and terms of a density that is written as one column expression.
CELLS, TERMS = 1 << 22, 600

#: Rows whose densities a task computes at a time.
BLOCK = 8192


@dataclass(frozen=True)
class _Parameters:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def whitening(self) -> np.ndarray:
        """Inverses of the Cholesky factors."""
        try:
            return np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c in self.covariances])
        except np.linalg.LinAlgError:
            raise SingularMatrixError("a covariance is singular; raise reg_covar or use fewer components") from None

    def log_densities(self, x: np.ndarray, white: np.ndarray) -> np.ndarray:
        """Logarithms of weight times density, rows by components."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, inv) in enumerate(zip(self.weights, self.means, white)):
            z = (x - m) @ inv.T
            with np.errstate(divide="ignore"):
                out[:, k] = np.log(w) + np.log(np.diag(inv)).sum() - 0.5 * (x.shape[1] * log(2 * pi) + (z * z).sum(1))
        return out


def _shares(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities and the logarithm of every row's density."""
    top = logs.max(1)
    e = np.exp(logs - top[:, None])
    total = e.sum(1)
    return e / total[:, None], top + np.log(total)


@dataclass(frozen=True)
class GaussianMixture(Config):
    """Full covariances. A fit starts from `init` (weights, means, covariances), or from k-means."""

    n_components: int = 1
    max_iter: int = 100
    tol: float = 1e-3
    reg_covar: float = 1e-6
    seed: int = 0

    def fit(self, df: DataFrame, features: list[str], init=None) -> "GaussianMixtureModel":
        """Rows are written once and read once a step; a step sends sums to the driver, as many as the parameters are.

        Ends when the mean log-likelihood moves by less than `tol`, or with a warning after `max_iter` steps.
        """
        p, k = len(features), self.n_components
        if k < 1 or self.max_iter < 1 or self.tol < 0 or self.reg_covar < 0:
            raise InvalidParameterError("n_components and max_iter >= 1, tol and reg_covar >= 0 are needed")
        if k * (p * p + p + 1) > CELLS:
            raise InvalidParameterError("too many parameters for the driver: fewer components or features are needed")
        n = checked(df, features)
        if k > n:
            raise InvalidParameterError("more components than rows")
        d = materialize(df.select(*[number(f).alias(f"x{j}") for j, f in enumerate(features)]), "mixture")
        try:
            now = self._given(init, k, p) if init is not None else self._start(d, p, n)
            before, converged, steps, bound = -np.inf, False, 0, -np.inf
            for steps in range(1, self.max_iter + 1):
                now, bound = self._step(d, now, n)
                converged = abs(bound - before) < self.tol
                if converged:
                    break
                before = bound
        finally:
            discard(d)
        if not converged:
            warnings.warn("the mixture stopped at max_iter", ConvergenceWarning, stacklevel=2)
        lists = lambda a: tuple(map(tuple, a.tolist()))
        return GaussianMixtureModel(tuple(features), tuple(now.weights.tolist()), lists(now.means), tuple(lists(c) for c in now.covariances), bound, steps, converged)

    def _given(self, init, k: int, p: int) -> _Parameters:
        now = _Parameters(*(np.array(a, float) for a in init))
        if now.weights.shape != (k,) or now.means.shape != (k, p) or now.covariances.shape != (k, p, p):
            raise InvalidParameterError("init doesn't fit the components and features")
        return now

    def _start(self, d: DataFrame, p: int, n: int) -> _Parameters:
        names = [f"x{j}" for j in range(p)]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", ConvergenceWarning)
            centers = np.array(KMeans(n_clusters=self.n_components, n_init=1, max_iter=20, seed=self.seed).fit(d, names).centroids)

        def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = ((x[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
            return np.eye(len(centers))[near], np.zeros(len(x))

        return self._moved(centers, *_sums(d, centers, nearest), n)

    def _step(self, d: DataFrame, now: _Parameters, n: int) -> tuple[_Parameters, float]:
        white = now.whitening()
        sums, likelihood = _sums(d, now.means, lambda x: _shares(now.log_densities(x, white)))
        return self._moved(now.means, sums, likelihood, n), likelihood / n

    def _moved(self, means: np.ndarray, sums: np.ndarray, likelihood: float, n: int) -> _Parameters:
        """Parameters from weighted sums about the old means."""
        p = means.shape[1]
        size = sums[:, 0] + 10 * np.finfo(float).eps
        shift = sums[:, 1 : 1 + p] / size[:, None]
        scatter = sums[:, 1 + p :].reshape(-1, p, p) / size[:, None, None]
        return _Parameters(size / size.sum(), means + shift, scatter - shift[:, :, None] * shift[:, None, :] + self.reg_covar * np.eye(p))


def _sums(d: DataFrame, means: np.ndarray, shares) -> tuple[np.ndarray, float]:
    """Per component the weights' sum and the weighted first and second moments about its mean; and the sum of the rows' log-densities. Tasks add up blocks, an aggregation the tasks."""
    k, p = means.shape

    def part(batches):
        total, likelihood = np.zeros((k, 1 + p + p * p)), 0.0
        for batch in batches:
            rows = np.stack([batch.column(j).to_numpy() for j in range(p)], axis=1)
            for at in range(0, len(rows), BLOCK):
                x = rows[at : at + BLOCK]
                r, logs = shares(x)
                likelihood += logs.sum()
                for c in range(k):
                    gap = x - means[c]
                    total[c, 0] += r[:, c].sum()
                    total[c, 1 : 1 + p] += r[:, c] @ gap
                    total[c, 1 + p :] += ((gap * r[:, c : c + 1]).T @ gap).reshape(-1)
        cells = np.append(total.reshape(-1), likelihood)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "v"])

    got = np.zeros(k * (1 + p + p * p) + 1)
    found = d.mapInArrow(part, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    got[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    return got[:-1].reshape(k, -1), float(got[-1])


@dataclass(frozen=True)
class GaussianMixtureModel:
    """lower_bound: the mean log-likelihood under the parameters before the last step."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    means: tuple[tuple[float, ...], ...]
    covariances: tuple[tuple[tuple[float, ...], ...], ...]
    lower_bound: float
    n_iter: int
    converged: bool

    def _parameters(self) -> _Parameters:
        return _Parameters(np.array(self.weights), np.array(self.means), np.array(self.covariances))

    def log_densities(self) -> Column:
        """Array of the components' log(weight times density): a column expression, or an Arrow function where it has many terms."""
        p, now = len(self.features), self._parameters()
        white = now.whitening()
        if len(self.weights) * p * (p + 1) // 2 > TERMS:

            @F.pandas_udf("array<double>")
            def densities(*columns: pd.Series) -> pd.Series:
                return pd.Series(list(now.log_densities(np.stack([c.to_numpy(float) for c in columns], axis=1), white)))

            return densities(*[number(f) for f in self.features])
        out = []
        for w, m, inv in zip(now.weights, now.means, white):
            total = F.lit(0.0)
            for i in range(p):
                z = sum(((number(f) - F.lit(float(m[j]))) * F.lit(float(inv[i, j])) for j, f in enumerate(self.features[: i + 1])), F.lit(0.0))
                total = total + z * z
            out.append(F.lit(float(np.log(max(w, 1e-300)) + np.log(np.diag(inv)).sum() - 0.5 * p * log(2 * pi))) - total / 2)
        return F.array(*out)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """The component of largest responsibility, the first of equals."""
        require(df, self.features)
        return df.withColumn("_l", self.log_densities()).withColumn(output, (F.array_position("_l", F.array_max("_l")) - 1).cast("int")).drop("_l")

    def predict_probabilities(self, df: DataFrame, output: str = "probability") -> DataFrame:
        require(df, self.features)
        e = df.withColumn("_l", self.log_densities()).withColumn("_m", F.array_max("_l")).withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.col("_m"))))
        return e.withColumn(output, F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y))).drop("_l", "_m", "_e")

    def log_likelihoods(self, df: DataFrame, output: str = "log_likelihood") -> DataFrame:
        require(df, self.features)
        e = df.withColumn("_l", self.log_densities()).withColumn("_m", F.array_max("_l"))
        return e.withColumn(output, F.col("_m") + F.log(F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_m"))))).drop("_l", "_m")

    def score(self, df: DataFrame) -> float:
        """Mean log-likelihood of the rows."""
        return float(self.log_likelihoods(df, "_s").agg(F.avg("_s")).first()[0])

    def _free(self) -> int:
        k, p = len(self.weights), len(self.features)
        return k - 1 + k * p + k * p * (p + 1) // 2

    def bic(self, df: DataFrame) -> float:
        n, mean = self.log_likelihoods(df, "_s").agg(F.count("*"), F.avg("_s")).first()
        return -2 * n * mean + self._free() * log(n)

    def aic(self, df: DataFrame) -> float:
        n, mean = self.log_likelihoods(df, "_s").agg(F.count("*"), F.avg("_s")).first()
        return -2 * n * mean + 2 * self._free()
