"""Reproducible pseudorandom columns from md5: the same stream in any engine that has md5."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int, *parts: Column | str) -> Column:
    """Hexadecimal digest of the seed and the parts: an order for shuffling."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def uniform(seed: int, *parts: Column | str) -> Column:
    """In [0, 1), from the first 32 bits."""
    return F.conv(F.substring(key(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed: int, *parts: Column | str) -> Column:
    """Standard normal, from two uniforms."""
    u = uniform(seed, *parts, F.lit("u"))
    v = uniform(seed, *parts, F.lit("v"))
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * pi * v)
