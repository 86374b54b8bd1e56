"""Generators and small fixed inputs, against SQL by the same rules: they read no table, so they are tests, not queries."""

from math import pi

import duckdb
import pytest

from millrace.operators.sparse import Sparse
from millrace.operators.tree import DecisionTreeClassifier
from millrace.queries import _md5, _r, rounded
from millrace.sources.datasets import COLUMNS, ROWS, load_diabetes, load_iris, load_wine, make_blobs, make_classification, make_regression

CASES = {}


def case(sql):
    def add(f):
        CASES[f.__name__] = f, sql
        return f

    return add


def _gauss(seed: int, *parts: str) -> str:
    u, v = _md5(seed, *parts, "'u'"), _md5(seed, *parts, "'v'")
    return f"(sqrt(-2.0 * ln(1.0 - {u})) * cos({2 * pi!r} * {v}))"


@case("SELECT i AS row_id, " + ", ".join(f"{_r(_md5(42, repr('center'), 'i % 4', str(j)) + ' * 20 - 10 + 0.5 * ' + _gauss(42, 'i', str(j)), 7)} AS f{j}" for j in range(3)) + ", (i % 4)::DOUBLE AS label FROM range(300) AS t(i)")
def blobs(spark):
    return rounded(make_blobs(spark, 300, 3, 4, 0.5, 42), 7, "f0", "f1", "f2")


@case(
    "WITH g AS (SELECT i, " + ", ".join(f"{_gauss(42, 'i', str(j))} AS f{j}" for j in range(2)) + " FROM range(500) AS t(i)), s AS (SELECT *, min(f0 + f1) OVER () AS lo, max(f0 + f1) OVER () AS hi FROM g) "
    f"SELECT i AS row_id, {_r('f0', 7)} AS f0, {_r('f1', 7)} AS f1, {_r('f0 * ' + _gauss(42, repr('mix'), '0', '0') + ' + f1 * ' + _gauss(42, repr('mix'), '0', '1'), 7)} AS f2, {_r(_gauss(42, 'i', '3'), 7)} AS f3, "
    f"CASE WHEN {_md5(42, repr('flip'), 'i')} < 0.05 THEN floor({_md5(42, repr('class'), 'i')} * 3) ELSE least(floor((f0 + f1 - lo) / ((hi - lo) / 3)), 2) END::DOUBLE AS label FROM s"
)
def classification_rows(spark):
    return rounded(make_classification(spark, 500, 4, 2, 1, 3, 0.05, 1.0, 42), 7, "f0", "f1", "f2", "f3")


@case("WITH g AS (SELECT i, " + ", ".join(f"{_gauss(9, 'i', str(j))} AS f{j}" for j in range(3)) + f" FROM range(400) AS t(i)) SELECT i AS row_id, {_r('f0', 7)} AS f0, {_r('f1', 7)} AS f1, {_r('f2', 7)} AS f2, {_r('5.0 + f0 * ' + _gauss(9, repr('coef'), '0') + ' + f1 * ' + _gauss(9, repr('coef'), '1') + ' + 0.1 * ' + _gauss(9, repr('noise'), 'i'), 7)} AS label FROM g")
def regression_rows(spark):
    return rounded(make_regression(spark, 400, 3, 2, 0.1, 5.0, 9), 7, "f0", "f1", "f2", "label")


@case("SELECT i AS row, ((i + 2 * j) % 7)::INT AS col, (i + 0.5 * j)::DOUBLE AS value FROM range(300) AS t(i), range(3) AS u(j) WHERE j < i % 4")
def sparse_from_csr(spark):
    """Row i has i % 4 entries."""
    cells = [[((i + 2 * j) % 7, i + 0.5 * j) for j in range(i % 4)] for i in range(300)]
    starts = [0]
    for row in cells:
        starts.append(starts[-1] + len(row))
    return Sparse.from_csr(spark, 300, 7, [v for row in cells for _, v in row], [c for row in cells for c, _ in row], starts).entries


@case("SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (0, 1, 1), (1, 0, 1), (1, 1, 0)) AS t(a, b, prediction)")
def tree_classifier_xor(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 1.0, 1.0), (1.0, 0.0, 1.0), (1.0, 1.0, 0.0)], "a double, b double, label double")
    return DecisionTreeClassifier().fit(df, ["a", "b"]).predict(df).select("a", "b", "prediction")


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_rows(spark, name):
    run, sql = CASES[name]
    df, r = run(spark), duckdb.sql(sql)
    plain = lambda row: tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)
    assert sorted(df.columns) == sorted(r.columns)
    assert sorted(map(plain, df.select(*r.columns).collect()), key=repr) == sorted(map(plain, r.fetchall()), key=repr)


@pytest.mark.parametrize("load,name", [(load_iris, "iris"), (load_diabetes, "diabetes"), (load_wine, "wine")])
def test_loaders(spark, tmp_path, load, name):
    columns, rows = COLUMNS[name], ROWS[name]
    values = [[float((i * (j + 3)) % 97) / 8 for j in range(len(columns))] + [float(i % 3)] for i in range(rows)]
    path = tmp_path / "table.csv"
    path.write_text("\n".join([",".join([*columns, "label"]), *[",".join(map(str, v)) for v in values]]))
    got = load(spark, str(path))
    assert got.columns == [*columns, "label"] and sorted(map(list, got.collect())) == sorted(values)
