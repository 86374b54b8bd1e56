"""Helpers over DataFrames: doubles, row numbers without a global sort in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import EmptyInputError, InvalidParameterError, require
from .scratch import discard, materialize


def number(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def checked(df: DataFrame, features: list[str], *more: str) -> int:
    """Rows of df; raises on a missing column, on no rows, and on null or NaN among features and labels (one aggregation)."""
    require(df, [*features, *more])
    bad = sum(((number(c).isNull() | F.isnan(number(c))).cast("long") for c in [*features, *more]), F.lit(0).cast("long"))
    n, wrong = df.agg(F.count("*"), F.sum(bad)).first()
    if not n:
        raise EmptyInputError("no rows")
    if wrong:
        raise InvalidParameterError(f"{wrong} null or NaN values; impute them first")
    return n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Adds 0-based positions in the given order: range partitions, a running number inside each, and their sizes (one row a partition) added up on the driver. It reads a written table, which its last reader may `discard`."""
    spark = df.sparkSession
    keyed = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = df.select("*", *keyed).repartitionByRange(partitions(spark), *keys).withColumn("_p", F.spark_partition_id())
    held = materialize(ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*keys))), "numbered")
    sizes = {r["_p"]: r["n"] for r in held.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    before, bases = 0, []
    for p in sorted(sizes):
        bases.append((p, before))
        before += sizes[p]
    table = spark.createDataFrame(bases, "_p int, _base bigint")
    out = held.join(F.broadcast(table), "_p").withColumn(name, F.col("_base") + F.col("_r") - 1).drop("_p", "_r", "_base", *keys)
    out.written_to = held.written_to
    return out


def order_statistics(df: DataFrame, columns: list[Column], ranks: Callable[[int], Iterable[int]]) -> list[dict[int, float]]:
    """Of each column the values at these ranks (from 1; given how many values it has) among what isn't null.

    Values are counted, dealt by ranges, and only the ranges that hold a rank are ordered. The driver gets a row a range and
    column, and the wanted values.
    """
    spark = df.sparkSession
    counts = df.select(F.posexplode(F.array(*columns)).alias("f", "v")).where("v IS NOT NULL").groupBy("f", "v").agg(F.count("*").alias("n"))
    held = materialize(counts.repartitionByRange(partitions(spark), "f", "v").withColumn("b", F.spark_partition_id()), "values")
    sums = sorted((r.f, r.b, r.n) for r in held.groupBy("f", "b").agg(F.sum("n").alias("n")).collect())  # a row a range and column
    wanted = []
    for f in range(len(columns)):
        total, before = sum(n for g, _, n in sums if g == f), 0
        asked = sorted(set(ranks(total))) if total else []
        for b, n in ((b, n) for g, b, n in sums if g == f):
            wanted += [(f, b, before, rank) for rank in asked if before < rank <= before + n]
            before += n
    out: list[dict[int, float]] = [{} for _ in columns]
    if wanted:
        upto = F.sum("n").over(Window.partitionBy("f", "b").orderBy("v"))
        table = spark.createDataFrame([(f, b, before, [r for g, c, _, r in wanted if (g, c) == (f, b)]) for f, b, before in sorted({w[:3] for w in wanted})], "f int, b int, before long, ranks array<long>")
        at = held.join(F.broadcast(table), ["f", "b"]).withColumn("upto", upto + F.col("before"))
        hit = at.select("f", "v", F.explode(F.filter("ranks", lambda r: (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r))).alias("rank"))
        for r in hit.collect():
            out[r.f][r.rank] = r.v
    discard(held)
    return out


def medians(df: DataFrame, columns: list[Column]) -> list[float | None]:
    """Exact medians of what isn't null, None without any."""
    found = order_statistics(df, columns, lambda n: ((n + 1) // 2, n // 2 + 1))
    return [min(x.values()) + (max(x.values()) - min(x.values())) / 2 if x else None for x in found]
