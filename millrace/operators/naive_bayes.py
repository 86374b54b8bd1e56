"""Gaussian naive Bayes: one grouped aggregation, prediction by expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Config, require
from ..plans.frame import checked, number


@dataclass(frozen=True)
class GaussianNB(Config):
    var_smoothing: float = 1e-9

    def fit(self, df: DataFrame, features: list[str], label: str = "label") -> "GaussianNBModel":
        """Means and population variances by class; a share of the greatest of those variances is added to all."""
        n = checked(df, features, label)
        rows = df.groupBy(number(label).alias("y")).agg(F.count("*").alias("n"), *[F.avg(number(c)) for c in features], *[F.var_pop(number(c)) for c in features]).collect()
        rows.sort(key=lambda r: r[0])
        p = len(features)
        extra = self.var_smoothing * max(v for r in rows for v in r[2 + p :])
        return GaussianNBModel(tuple(features), tuple(r[0] for r in rows), tuple(r[1] / n for r in rows), tuple(tuple(r[2 : 2 + p]) for r in rows), tuple(tuple(v + extra for v in r[2 + p :]) for r in rows))


@dataclass(frozen=True)
class GaussianNBModel:
    features: tuple[str, ...]
    classes: tuple[float, ...]
    priors: tuple[float, ...]
    theta: tuple[tuple[float, ...], ...]
    sigma: tuple[tuple[float, ...], ...]

    def log_posterior(self) -> list[Column]:
        """Unnormalised, by class. A class without any spread has density at its means only."""
        out = []
        for prior, mean, var in zip(self.priors, self.theta, self.sigma):
            total = F.lit(log(prior) - 0.5 * sum(log(2 * pi * v) for v in var if v > 0))
            for c, m, v in zip(self.features, mean, var):
                d = number(c) - F.lit(m)
                total = total - (F.lit(0.5) * d * d / F.lit(v) if v > 0 else F.when(d == 0, 0.0).otherwise(float("inf")))
            out.append(total)
        return out

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """The likeliest class, the smaller one of equals."""
        require(df, self.features)
        a = F.array(*self.log_posterior())
        held = df.withColumn("_lp", a)
        return held.withColumn(output, F.get(F.array(*[F.lit(c) for c in self.classes]), (F.array_position("_lp", F.array_max("_lp")) - 1).cast("int"))).drop("_lp")

    def predict_probabilities(self, df: DataFrame, output: str = "probability") -> DataFrame:
        require(df, self.features)
        held = df.withColumn("_lp", F.array(*self.log_posterior())).withColumn("_m", F.array_max("_lp"))
        held = held.withColumn("_e", F.transform("_lp", lambda x: F.exp(x - F.col("_m")))).withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
        return held.withColumn(output, F.transform("_e", lambda x: x / F.col("_s"))).drop("_lp", "_m", "_e", "_s")
