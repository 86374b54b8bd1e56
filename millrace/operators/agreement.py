"""Agreement of two labellings: counts of pairs of labels, and what chance would give."""

from __future__ import annotations

from math import lgamma, log, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import EmptyInputError, InvalidParameterError

#: Labels of either side up to which the expectation under chance is computed (their sizes go to the driver).
MOST = 65_536

#: Standard deviations around a cell's expected count; what lies beyond adds less than rounding does.
REACH = 45


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, na, nb): how many rows have both labels, and each. Null is a label. Labels are counted before they are joined, so no label's rows meet in one task."""
    n = df.groupBy(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).agg(F.count("*").alias("n"))
    na = n.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("na"))
    nb = n.groupBy(F.col("b").alias("_b")).agg(F.sum("n").alias("nb"))
    return n.join(na, F.col("a").eqNullSafe(F.col("_a"))).join(nb, F.col("b").eqNullSafe(F.col("_b"))).select("a", "b", "n", "na", "nb")


def _pairs(c: Column) -> Column:
    return c.cast("double") * (c - 1) / 2


def agreement_table(df: DataFrame, a: str = "label", b: str = "prediction") -> DataFrame:
    """One row: rows n, adjusted_rand, mutual_information, entropy_a, entropy_b (natural logarithms), homogeneity, completeness, v_measure, normalized_mutual_information.

    One label on both sides, or labels that no two rows share, agree fully. Without rows: one row of nulls and n = 0.
    """
    t = contingency(df, a, b)
    rows = df.count()
    n, na, nb, every = F.col("n"), F.col("na"), F.col("nb"), F.lit(rows)
    share = n / every
    one = t.agg(
        F.lit(rows).cast("long").alias("n"),
        F.sum(_pairs(n)).alias("both"),
        F.sum(_pairs(na) * n / na).alias("first"),  # every label of a once, spread over its cells
        F.sum(_pairs(nb) * n / nb).alias("second"),
        F.sum(share * F.log(n * every / (na.cast("double") * nb))).alias("mi"),
        (-F.sum(share * F.log(na / every))).alias("ha"),
        (-F.sum(share * F.log(nb / every))).alias("hb"),
    )
    chance = F.try_divide(F.col("first") * F.col("second"), _pairs(F.col("n")))
    most = (F.col("first") + F.col("second")) / 2
    rand = F.when(F.col("n") == 0, None).otherwise(F.coalesce(F.try_divide(F.col("both") - chance, most - chance), F.lit(1.0)))
    mi = F.greatest(F.col("mi"), F.lit(0.0))
    part = lambda h: F.when(F.col("n") == 0, None).when(h <= 1e-15, 1.0).otherwise(F.least(mi / h, F.lit(1.0)))
    out = one.select("n", rand.alias("adjusted_rand"), mi.alias("mutual_information"), F.greatest("ha", F.lit(0.0)).alias("entropy_a"), F.greatest("hb", F.lit(0.0)).alias("entropy_b"), part(F.col("ha")).alias("homogeneity"), part(F.col("hb")).alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    v = F.when(both > 0, 2 * F.col("homogeneity") * F.col("completeness") / both).when(both == 0, 0.0)
    mean = (F.col("entropy_a") + F.col("entropy_b")) / 2
    normal = F.when(F.col("n") == 0, None).when(mean <= 1e-15, 1.0).otherwise(F.col("mutual_information") / mean)
    return out.withColumn("v_measure", v).withColumn("normalized_mutual_information", normal)


def adjusted_rand(df: DataFrame, a: str = "label", b: str = "prediction") -> float:
    return _value(df, a, b, "adjusted_rand")


def normalized_mutual_information(df: DataFrame, a: str = "label", b: str = "prediction") -> float:
    return _value(df, a, b, "normalized_mutual_information")


def _value(df: DataFrame, a: str, b: str, name: str) -> float:
    got = agreement_table(df, a, b).first()
    if not got.n:
        raise EmptyInputError("no rows")
    return float(got[name])


def adjusted_mutual_information(df: DataFrame, a: str = "label", b: str = "prediction") -> float:
    """Mutual information less what chance gives, over the mean entropy less the same. The driver gets the sizes of labels and how many have each."""
    got = agreement_table(df, a, b).first()
    if not got.n:
        raise EmptyInputError("no rows")
    sizes = []
    for side in (a, b):
        labels = df.groupBy(F.col(f"`{side}`")).agg(F.count("*").alias("size"))
        rows = labels.groupBy("size").agg(F.count("*").alias("times")).limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise InvalidParameterError(f"labels of more than {MOST} sizes")
        sizes.append([(r["size"], r["times"]) for r in rows])
    expected = sum(s * t * _expected_cell(x, y, got.n) for x, s in sizes[0] for y, t in sizes[1])
    mean = (got.entropy_a + got.entropy_b) / 2
    return 1.0 if abs(mean - expected) < 1e-15 else float((got.mutual_information - expected) / (mean - expected))


def _expected_cell(a: int, b: int, n: int) -> float:
    """What a cell of two labels of these sizes adds to the mutual information on average, if rows are dealt at random (hypergeometric)."""
    middle = a * b / n
    spread = REACH * (sqrt(middle * (1 - a / n) * (1 - b / n)) + 1)
    low, high = max(1, a + b - n, int(middle - spread)), min(a, b, int(middle + spread) + 1)
    if low > high:
        return 0.0
    x = np.arange(low, high + 1, dtype=float)
    first = _choose(a, low) + _choose(n - a, b - low) - _choose(n, b)
    steps = np.log((a - x[:-1]) * (b - x[:-1])) - np.log((x[:-1] + 1) * (n - a - b + x[:-1] + 1))
    chance = np.exp(first + np.concatenate([[0.0], np.cumsum(steps)]))
    return float((chance * x / n * np.log(n * x / (float(a) * b))).sum())


def _choose(n: int, k: int) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) if 0 < k < n else 0.0 if k in (0, n) else -log(0.0)
