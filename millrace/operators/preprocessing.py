"""Scalers, encoders and imputation: fits are one aggregation, transforms are projections."""

from __future__ import annotations

from dataclasses import dataclass
from math import isnan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Config, DimensionMismatchError, EmptyInputError, FitTransformMixin, InvalidParameterError, require
from ..plans.frame import checked, medians, number


def _replace(df: DataFrame, features, exprs) -> DataFrame:
    """df with the features replaced, in one projection."""
    new = dict(zip(features, exprs))
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


@dataclass(frozen=True)
class StandardScaler(Config, FitTransformMixin):
    with_mean: bool = True
    with_std: bool = True

    def fit(self, df: DataFrame, features: list[str]) -> "StandardScalerModel":
        """Means and population deviations; a constant column is scaled by 1."""
        checked(df, features)
        got = df.agg(*[F.avg(number(c)) for c in features], *[F.stddev_pop(number(c)) for c in features]).first()
        p = len(features)
        return StandardScalerModel(tuple(features), tuple(got[:p]) if self.with_mean else None, tuple(s or 1.0 for s in got[p:]) if self.with_std else None)


@dataclass(frozen=True)
class StandardScalerModel:
    features: tuple[str, ...]
    mean: tuple[float, ...] | None
    scale: tuple[float, ...] | None

    def _parts(self):
        p = len(self.features)
        return zip(self.features, self.mean or (0.0,) * p, self.scale or (1.0,) * p)

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, self.features)
        return _replace(df, self.features, [(number(c) - F.lit(m)) / F.lit(s) for c, m, s in self._parts()])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        require(df, self.features)
        return _replace(df, self.features, [number(c) * F.lit(s) + F.lit(m) for c, m, s in self._parts()])


@dataclass(frozen=True)
class MinMaxScaler(Config, FitTransformMixin):
    feature_min: float = 0.0
    feature_max: float = 1.0

    def fit(self, df: DataFrame, features: list[str]) -> "MinMaxScalerModel":
        if self.feature_min >= self.feature_max:
            raise InvalidParameterError("feature_min must be below feature_max")
        checked(df, features)
        got = df.agg(*[F.min(number(c)) for c in features], *[F.max(number(c)) for c in features]).first()
        p = len(features)
        low, high = tuple(got[:p]), tuple(got[p:])
        scale = tuple((self.feature_max - self.feature_min) / (b - a) if b > a else 0.0 for a, b in zip(low, high))
        return MinMaxScalerModel(tuple(features), low, high, scale, tuple(self.feature_min - a * s for a, s in zip(low, scale)))


@dataclass(frozen=True)
class MinMaxScalerModel:
    features: tuple[str, ...]
    data_min: tuple[float, ...]
    data_max: tuple[float, ...]
    scale: tuple[float, ...]
    offset: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Values outside the fitted range are not clipped."""
        require(df, self.features)
        return _replace(df, self.features, [number(c) * F.lit(s) + F.lit(o) for c, s, o in zip(self.features, self.scale, self.offset)])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """A constant column comes back as its value."""
        require(df, self.features)
        return _replace(df, self.features, [(number(c) - F.lit(o)) / F.lit(s) if s else F.lit(m) for c, s, o, m in zip(self.features, self.scale, self.offset, self.data_min)])


@dataclass(frozen=True)
class OneHotEncoder(Config, FitTransformMixin):
    drop_first: bool = False

    def fit(self, df: DataFrame, features: list[str]) -> "OneHotEncoderModel":
        """Sorted distinct non-negative integers of every column; anything else is an error."""
        require(df, features)
        bad = [F.max((number(c).isNull() | F.isnan(number(c)) | (number(c) < 0) | (number(c) != F.floor(number(c))) | (number(c) == float("inf"))).cast("int")) for c in features]
        got = df.agg(F.count("*"), *bad, *[F.sort_array(F.collect_set(number(c))) for c in features]).first()
        if not got[0]:
            raise EmptyInputError("no rows")
        p = len(features)
        if any(got[1 : 1 + p]):
            raise InvalidParameterError("categories must be non-negative integers")
        return OneHotEncoderModel(tuple(features), tuple(tuple(x) for x in got[1 + p :]), self.drop_first)


@dataclass(frozen=True)
class OneHotEncoderModel:
    features: tuple[str, ...]
    categories: tuple[tuple[float, ...], ...]
    drop_first: bool

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(f"{c}_{int(v)}" for c, vs in zip(self.features, self.categories) for v in vs[self.drop_first :])

    @property
    def n_output_features(self) -> int:
        return len(self.outputs)

    def transform(self, df: DataFrame) -> DataFrame:
        """One column a category in place of the features; an unknown category fails the query when its row is read."""
        require(df, self.features)
        out = [F.col(f"`{c}`") for c in df.columns if c not in self.features]
        for c, vs in zip(self.features, self.categories):
            fail = F.raise_error(F.concat(F.lit(f"unknown category of {c}: "), number(c).cast("string"))).cast("double")
            known = F.coalesce(number(c).isin(list(vs)), F.lit(False))
            out += [F.when(~known, fail).otherwise((number(c) == v).cast("double")).alias(f"{c}_{int(v)}") for v in vs[self.drop_first :]]
        return df.select(*out)


#: Up to this many classes a label is looked up by comparisons, beyond it by a join; up to this many bytes of classes are broadcast.
LITERAL, BROADCAST = 256, 32 << 20


def _chosen(x: Column, classes, low: int, high: int) -> Column:
    out = F.lit(None).cast("double")
    for k in range(low, high):
        out = F.when(x == classes[k], float(k)).otherwise(out)
    return out


@dataclass(frozen=True)
class LabelEncoder(Config, FitTransformMixin):
    def fit(self, df: DataFrame, features: list[str]) -> "LabelEncoderModel":
        if len(features) != 1:
            raise DimensionMismatchError("one column is encoded at a time")
        checked(df, features)
        return LabelEncoderModel(features[0], tuple(df.agg(F.sort_array(F.collect_set(number(features[0])))).first()[0]))


@dataclass(frozen=True)
class LabelEncoderModel:
    feature: str
    classes: tuple[float, ...]

    def _classes(self):
        return F.array(*[F.lit(c) for c in self.classes])

    def _position(self, x: Column, low: int, high: int) -> Column:
        """Number of the class among classes[low:high], by halving; null if it isn't there."""
        if high - low <= 4:
            return _chosen(x, self.classes, low, high)
        middle = (low + high) // 2
        return F.when(x < self.classes[middle], self._position(x, low, middle)).otherwise(self._position(x, middle, high))

    def transform(self, df: DataFrame) -> DataFrame:
        """Class numbers from 0; an unknown label fails the query."""
        require(df, [self.feature])
        fail = F.raise_error(F.lit(f"unknown label of {self.feature}")).cast("double")
        if len(self.classes) <= LITERAL:
            return _replace(df, [self.feature], [F.coalesce(self._position(number(self.feature), 0, len(self.classes)), fail)])
        table = df.sparkSession.createDataFrame([(c, float(k)) for k, c in enumerate(self.classes)], "_class double, _number double")
        table = F.broadcast(table) if 16 * len(self.classes) <= BROADCAST else table
        found = df.join(table, number(self.feature) == F.col("_class"), "left")
        return _replace(found, [self.feature], [F.coalesce("_number", fail)]).drop("_class", "_number")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Labels of class numbers (their integer part); one out of range fails the query."""
        require(df, [self.feature])
        value = F.get(self._classes(), number(self.feature).cast("int"))
        return _replace(df, [self.feature], [F.coalesce(value, F.raise_error(F.lit("class number out of range")).cast("double"))])


STRATEGIES = ("mean", "median", "constant")


@dataclass(frozen=True)
class SimpleImputer(Config, FitTransformMixin):
    strategy: str = "mean"
    fill_value: float = 0.0

    def fit(self, df: DataFrame, features: list[str]) -> "SimpleImputerModel":
        """Statistics of what is neither null nor NaN; a column without any keeps NaN."""
        if self.strategy not in STRATEGIES:
            raise InvalidParameterError(f"unknown strategy {self.strategy!r}")
        require(df, features)
        present = [F.nanvl(number(c), F.lit(None).cast("double")) for c in features]
        n, *means = df.agg(F.count("*"), *[F.avg(x) for x in present if self.strategy == "mean"]).first()
        if not n:
            raise EmptyInputError("no rows")
        got = {"mean": lambda: means, "median": lambda: medians(df, present), "constant": lambda: [self.fill_value] * len(features)}[self.strategy]()
        return SimpleImputerModel(tuple(features), tuple(float("nan") if v is None else float(v) for v in got))


@dataclass(frozen=True)
class SimpleImputerModel:
    features: tuple[str, ...]
    statistics: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, self.features)
        return _replace(df, self.features, [F.coalesce(F.nanvl(number(c), F.lit(None).cast("double")), F.lit(float("nan") if isnan(s) else s)) for c, s in zip(self.features, self.statistics)])
