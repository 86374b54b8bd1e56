"""Isotonic regression: adjacent violators are pooled inside ranges of the feature, then over the ranges' ends."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Config, EmptyInputError, InvalidParameterError, require
from ..plans.frame import number, partitions
from ..plans.scratch import discard, materialize
from . import metrics

#: Blocks up to which one task pools what is left, and steps that a model may have (it is held as arrays).
ONE_TASK, MOST = 1 << 20, 1 << 22

_KIND = "low double, high double, w double, s double"


def pooled(low: np.ndarray, high: np.ndarray, w: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
    """Blocks in order of the feature, neighbours joined until means rise: ends, weights, weighted sums of the labels. One pass over a stack."""
    out: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), w.tolist(), s.tolist()):
        a, b, weight, total = block
        while out and out[-1][3] * weight >= total * out[-1][2]:
            last = out.pop()
            a, weight, total = last[0], weight + last[2], total + last[3]
        out.append([a, b, weight, total])
    return [np.array(c) for c in zip(*out)] if out else [np.zeros(0)] * 4


def _pool(batches):
    """A task's blocks, whatever its batches."""
    held = [np.zeros(0)] * 4
    for batch in batches:
        new = [batch.column(c).to_numpy() for c in ("low", "high", "w", "s")]
        held = pooled(*(np.concatenate(x) for x in zip(held, new)))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["low", "high", "w", "s"])


@dataclass(frozen=True)
class IsotonicRegression(Config):
    """increasing: the direction. outside: `clip` predictions beyond the training values, or null (`null`)."""

    increasing: bool = True
    outside: str = "clip"

    def fit(self, df: DataFrame, feature: str, label: str = "label", weight: str | None = None) -> "IsotonicModel":
        """Rows of equal values are one with their weighted mean. Null or NaN values, labels and weights are errors, and so are weights that aren't positive.

        Values are summed by an aggregation, dealt by ranges, and pooled in every range. What is left is finished in one task if it is
        at most ONE_TASK blocks. More blocks are pooled over the ends of ranges, from the middle of a range to the middle of
        the next, until no end violates the order; every round joins blocks.
        """
        require(df, [feature, label, *([weight] if weight else [])])
        if self.outside not in ("clip", "null"):
            raise InvalidParameterError("outside must be clip or null")
        x, y, w = number(feature), number(label), number(weight) if weight else F.lit(1.0)
        n, bad = df.agg(F.count("*"), F.sum((x.isNull() | F.isnan(x) | y.isNull() | F.isnan(y) | w.isNull() | F.isnan(w) | (w <= 0)).cast("long"))).first()
        if not n:
            raise EmptyInputError("no rows")
        if bad:
            raise InvalidParameterError(f"{bad} rows with null or NaN values or weights that aren't positive")
        y = y if self.increasing else -y
        sums = df.select((x + 0.0).alias("low"), w.alias("w"), (w * y).alias("s")).groupBy("low").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
        rows = sums.select("low", F.col("low").alias("high"), "w", "s")
        cur = materialize(rows.repartitionByRange(partitions(df.sparkSession), "low").sortWithinPartitions("low").mapInArrow(_pool, _KIND).withColumn("p", F.spark_partition_id()), "isotonic")
        while (left := cur.count()) > ONE_TASK and (places := self._meetings(cur)):
            old, cur = cur, self._met(cur, places)
            discard(old)
        final = cur if left > ONE_TASK else cur.coalesce(1).sortWithinPartitions("low").mapInArrow(_pool, _KIND)
        if left > MOST and final.count() > MOST:
            discard(cur)
            raise InvalidParameterError(f"more than {MOST} steps; round the feature first")
        found = final.select("low", "high", (F.col("s") / F.col("w")).alias("v")).toArrow()
        discard(cur)
        low, high, v = (found.column(c).to_numpy() for c in ("low", "high", "v"))
        order = np.argsort(low, kind="stable")
        sign = 1.0 if self.increasing else -1.0
        return IsotonicModel(feature, tuple(low[order].tolist()), tuple(high[order].tolist()), tuple((sign * v[order] + 0.0).tolist()), self.outside)

    @staticmethod
    def _meetings(blocks: DataFrame) -> list[tuple[int, int, int, float]]:
        """How ranges are cut anew: (p, new number, side, middle). A range's last mean above the next one's first makes them a pair, unless the range is in a pair
        already: then the upper half of one (side 0) and the lower half of the other (side 1) are a range. Others stay (side -1). Empty if no end violates the order: a row a range goes to the driver.
        """
        block = F.struct("w", "s")
        ends = blocks.groupBy("p").agg(F.min_by(block, "low").alias("first"), F.max_by(block, "low").alias("last"), F.min("low").alias("low"), F.percentile_approx("low", 0.5, 10_000).alias("m")).orderBy("low").collect()
        out, number, i, pairs = [], 0, 0, 0
        while i < len(ends):
            a = ends[i]
            b = ends[i + 1] if i + 1 < len(ends) else None
            if b is not None and a["last"].s * b["first"].w > b["first"].s * a["last"].w:  # compared as `pooled` compares
                out += [(a.p, number, 0, a.m), (b.p, number, 1, b.m)]
                number, i, pairs = number + 3, i + 2, pairs + 1
            else:
                out.append((a.p, number, -1, a.m))
                number, i = number + 1, i + 1
        return out if pairs else []

    @staticmethod
    def _met(blocks: DataFrame, places: list[tuple[int, int, int, float]]) -> DataFrame:
        """Pooled in the new ranges. A single block is both halves of its range, so every pair joins two blocks at least."""
        table = blocks.sparkSession.createDataFrame(places, "p int, number int, side int, m double")
        g = F.when(F.col("side") < 0, 0).when(F.col("side") == 0, F.when(F.col("low") >= F.col("m"), 1).otherwise(0)).otherwise(F.when(F.col("low") <= F.col("m"), 1).otherwise(2))
        dealt = blocks.join(F.broadcast(table), "p").withColumn("g", (F.col("number") + g).cast("int"))
        again = dealt.repartitionById(places[-1][1] + 3, F.col("g")).sortWithinPartitions("low").mapInArrow(_pool, _KIND).withColumn("p", F.spark_partition_id())
        return materialize(again, "isotonic")


@dataclass(frozen=True)
class IsotonicModel:
    """Steps: from `low` to `high` the fit is `values`; between steps it is a straight line."""

    feature: str
    low: tuple[float, ...]
    high: tuple[float, ...]
    values: tuple[float, ...]
    outside: str

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Null for null and NaN values. In Arrow batches, by halving."""
        require(df, [self.feature])
        x, y = np.stack([self.low, self.high], axis=1).reshape(-1), np.repeat(self.values, 2)
        shared, clip = df.sparkSession.sparkContext.broadcast((x, y)), self.outside == "clip"

        @F.pandas_udf("double")
        def line(values: pd.Series) -> pd.Series:
            x, y = shared.value
            v = values.to_numpy(float, na_value=np.nan)
            out = np.interp(v, x, y)
            bad = np.isnan(v) if clip else np.isnan(v) | (v < x[0]) | (v > x[-1])
            return pd.Series(out).mask(bad, None)

        return df.withColumn(output, line(number(self.feature)))

    def score(self, df: DataFrame, label: str = "label") -> float:
        return metrics.r2(self.predict(df, "_p"), label, "_p")
