"""Linear models from sufficient statistics: the rows are read once (logistic regression: once a Newton step), solved on the driver, predicted by expressions."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Config, ConvergenceWarning, InvalidParameterError, SingularMatrixError, require
from ..plans.frame import checked, number
from ..plans.gram import Moments, dot, moments
from ..plans.scratch import discard, materialize
from . import metrics


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        return dot(self.features, self.coefficients, self.intercept)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, self.column())

    def score(self, df: DataFrame, label: str = "label") -> float:
        """R squared."""
        return metrics.r2(self.predict(df, "_p"), label, "_p")


def _stats(df: DataFrame, features: list[str], label: str) -> Moments:
    require(df, [*features, label])
    return moments(df, [*(number(c) for c in features), number(label)])


def _parts(m: Moments, intercept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Products of features, of features with the label, and means (zero without an intercept)."""
    s = m.scatter if intercept else m.raw()
    mean = m.mean if intercept else np.zeros_like(m.mean)
    return s[:-1, :-1], s[:-1, -1], mean[:-1], float(mean[-1])


def _model(features, w: np.ndarray, mean: np.ndarray, target: float) -> LinearModel:
    return LinearModel(tuple(features), tuple(map(float, w)), float(target - mean @ w))


def ols_from(m: Moments, features, intercept: bool = True) -> LinearModel:
    g, c, mean, target = _parts(m, intercept)
    scale = np.sqrt(np.diag(g))
    if m.n < len(c) or (scale == 0).any() or np.linalg.cond(g / np.outer(scale, scale)) > 1e14:
        raise SingularMatrixError("features are linearly dependent")
    return _model(features, np.linalg.solve(g / np.outer(scale, scale), c / scale) / scale, mean, target)


def ridge_from(m: Moments, features, alpha: float, intercept: bool = True) -> LinearModel:
    g, c, mean, target = _parts(m, intercept)
    try:
        w = np.linalg.solve(g + alpha * np.eye(len(c)), c)
    except np.linalg.LinAlgError as e:
        raise SingularMatrixError("features are linearly dependent") from e
    return _model(features, w, mean, target)


def elastic_from(m: Moments, features, alpha: float, l1_ratio: float, intercept: bool, max_iter: int, tol: float) -> LinearModel:
    """Cyclic coordinate descent on the products: no further pass over the rows."""
    g, c, mean, target = _parts(m, intercept)
    one, two, w = alpha * l1_ratio * m.n, alpha * (1 - l1_ratio) * m.n, np.zeros(len(c))
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(c)):
            if g[j, j] == 0:
                continue
            rho = c[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - one, 0.0) / (g[j, j] + two)
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tol:
            break
    else:
        warnings.warn("coordinate descent stopped at max_iter", ConvergenceWarning, stacklevel=2)
    return _model(features, w, mean, target)


@dataclass(frozen=True)
class LinearRegression(Config):
    fit_intercept: bool = True

    def from_moments(self, m: Moments, features) -> LinearModel:
        return ols_from(m, features, self.fit_intercept)

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> LinearModel:
        return self.from_moments(_stats(df, features, label), features)


@dataclass(frozen=True)
class Ridge(Config):
    alpha: float = 1.0
    fit_intercept: bool = True

    def from_moments(self, m: Moments, features) -> LinearModel:
        if self.alpha < 0:
            raise InvalidParameterError("alpha must not be negative")
        return ridge_from(m, features, self.alpha, self.fit_intercept)

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> LinearModel:
        if self.alpha < 0:
            raise InvalidParameterError("alpha must not be negative")
        return self.from_moments(_stats(df, features, label), features)


@dataclass(frozen=True)
class ElasticNet(Config):
    alpha: float = 1.0
    l1_ratio: float = 0.5
    fit_intercept: bool = True
    max_iter: int = 1000
    tol: float = 1e-4

    def from_moments(self, m: Moments, features) -> LinearModel:
        if self.alpha < 0 or not 0 <= self.l1_ratio <= 1:
            raise InvalidParameterError("alpha must not be negative, l1_ratio must lie in [0, 1]")
        return elastic_from(m, features, self.alpha, self.l1_ratio, self.fit_intercept, self.max_iter, self.tol)

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> LinearModel:
        if self.alpha < 0 or not 0 <= self.l1_ratio <= 1:
            raise InvalidParameterError("alpha must not be negative, l1_ratio must lie in [0, 1]")
        return self.from_moments(_stats(df, features, label), features)


@dataclass(frozen=True)
class Lasso(Config):
    alpha: float = 1.0
    fit_intercept: bool = True
    max_iter: int = 1000
    tol: float = 1e-4

    def _net(self) -> ElasticNet:
        return ElasticNet(self.alpha, 1.0, self.fit_intercept, self.max_iter, self.tol)

    def from_moments(self, m: Moments, features) -> LinearModel:
        return self._net().from_moments(m, features)

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> LinearModel:
        return self._net().fit(df, features, label)


def _sigmoid(z: Column) -> Column:
    """Without overflow on either side."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


@dataclass(frozen=True)
class LogisticModel:
    """Weights and an intercept for class 1 of two, or for each of more classes against the rest."""

    features: tuple[str, ...]
    classes: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    @property
    def coefficients(self) -> tuple[float, ...]:
        return tuple(w for row in self.weights for w in row)

    def probability(self) -> Column:
        """Array by class: the sigmoid and its complement, or each class's sigmoid over their sum."""
        s = [_sigmoid(dot(self.features, w, b)) for w, b in zip(self.weights, self.intercepts)]
        if len(s) == 1:
            return F.array(1.0 - s[0], s[0])
        raw = F.array(*s)
        return F.transform(raw, lambda x: F.coalesce(F.try_divide(x, F.aggregate(raw, F.lit(0.0), lambda a, y: a + y)), F.lit(0.0)))

    def predict_probabilities(self, df: DataFrame, output: str = "probability") -> DataFrame:
        require(df, self.features)
        return df.withColumn(output, self.probability())

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """The likeliest class, the smaller one of equals."""
        require(df, self.features)
        z = [dot(self.features, w, b) for w, b in zip(self.weights, self.intercepts)]
        if len(z) == 1:
            return df.withColumn(output, F.when(z[0] > 0, self.classes[1]).otherwise(self.classes[0]))
        s = F.array(*[_sigmoid(x) for x in z])
        return df.withColumn(output, F.get(F.array(*[F.lit(c) for c in self.classes]), (F.array_position(s, F.array_max(s)) - 1).cast("int")))

    def score(self, df: DataFrame, label: str = "label") -> float:
        return metrics.accuracy(self.predict(df, "_p"), label, "_p")


#: Up to this many aggregate expressions a step is one plan in generated code; beyond it blocks of rows go through matrix products.
EXPRESSIONS = 400


def _likelihood(d: DataFrame, p: int, live: int, beta, positive) -> list[float]:
    """For each class the mean loss, gradient and upper half of the Hessian (rows x0.., y; `live` weights, the last one for the intercept)."""
    width = 1 + live + live * (live + 1) // 2
    if width * len(beta) <= EXPRESSIONS:
        names, aggs = [f"x{i}" for i in range(p)], []
        for b, c in zip(beta, positive):
            z = dot(names, b[:-1], b[-1])
            t = (F.col("y") == c).cast("double")
            s = _sigmoid(z)
            x = [*(F.col(n) for n in names), F.lit(1.0)]
            aggs.append(F.avg(F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))))
            aggs += [F.avg((s - t) * x[i]) for i in range(live)]
            aggs += [F.avg(s * (1 - s) * x[i] * x[j]) for i in range(live) for j in range(i, live)]
        return list(d.agg(*aggs).first())
    weights, classes, upper = np.array(beta), np.array(positive), np.triu_indices(live)

    def part(batches):
        """Sums of a partition, as rows: they are combined before their exchange. The last cell counts rows."""
        total, n = np.zeros((len(classes), width)), 0
        for b in batches:
            x = np.stack([*(b.column(i).to_numpy() for i in range(p)), np.ones(len(b))], axis=1)
            z = x @ weights.T
            t = b.column(p).to_numpy()[:, None] == classes
            small = np.exp(-np.abs(z))
            s = np.where(z >= 0, 1.0, small) / (1 + small)
            total[:, 0] += (np.maximum(z, 0) - z * t + np.log1p(small)).sum(0)
            x = x[:, :live]
            total[:, 1 : 1 + live] += (s - t).T @ x
            for k in range(len(classes)):
                total[k, 1 + live :] += ((x * (s[:, k] * (1 - s[:, k]))[:, None]).T @ x)[upper]
            n += len(b)
        values = np.append(total.reshape(-1), float(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "v"])

    sums = np.zeros(width * len(beta) + 1)
    for r in d.mapInArrow(part, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        sums[r.cell] = r.v
    return list(sums[:-1] / sums[-1])


@dataclass(frozen=True)
class LogisticRegression(Config):
    """Mean log loss and half the squared weights over c; the intercept is free. More than two classes: one against the rest."""

    c: float = 1.0
    fit_intercept: bool = True
    max_iter: int = 100
    tol: float = 1e-4

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> LogisticModel:
        if self.c <= 0:
            raise InvalidParameterError("c must be positive")
        checked(df, features, label)
        classes = tuple(sorted(r[0] for r in df.select(number(label)).distinct().collect()))
        if len(classes) < 2:
            raise InvalidParameterError("two classes at least")
        positive = classes[1:] if len(classes) == 2 else classes
        d = df.select(*[number(f).alias(f"x{i}") for i, f in enumerate(features)], number(label).alias("y"))
        d = materialize(d, "logistic")
        beta = self._newton(d, len(features), positive)
        discard(d)
        return LogisticModel(tuple(features), classes, tuple(tuple(map(float, b[:-1])) for b in beta), tuple(float(b[-1]) for b in beta))

    def _newton(self, d: DataFrame, p: int, positive) -> list[np.ndarray]:
        """Newton steps, halved while they don't lower the loss; all classes share each aggregation."""
        live = p + 1 if self.fit_intercept else p
        reg = np.append(np.full(p, 1 / self.c), 0.0)
        beta = [np.zeros(p + 1) for _ in positive]
        step = [None] * len(positive)
        last: list[float | None] = [None] * len(positive)
        open_ = set(range(len(positive)))
        for _ in range(self.max_iter):
            keys = sorted(open_)
            got = _likelihood(d, p, live, [beta[k] for k in keys], [positive[k] for k in keys])
            width = 1 + live + live * (live + 1) // 2
            for n, k in enumerate(keys):
                part = got[n * width : (n + 1) * width]
                b = beta[k]
                loss = part[0] + 0.5 * float(reg @ (b * b))
                if last[k] is not None and loss > last[k] + 1e-12:
                    step[k] = step[k] / 2
                    beta[k] = b - step[k]
                    if np.abs(step[k]).max() < 1e-12:
                        open_.discard(k)
                    continue
                last[k] = loss
                grad = np.array(part[1 : 1 + live]) + (reg * b)[:live]
                if np.abs(grad).max() < self.tol * 1e-5:
                    open_.discard(k)
                    continue
                h = np.zeros((live, live))
                h[np.triu_indices(live)] = part[1 + live :]
                h = h + np.triu(h, 1).T + np.diag(reg[:live])
                move = np.zeros(p + 1)
                move[:live] = -np.linalg.lstsq(h, grad, rcond=None)[0]
                step[k], beta[k] = move, b + move
            if not open_:
                break
        else:
            warnings.warn("Newton steps stopped at max_iter", ConvergenceWarning, stacklevel=2)
        return beta
