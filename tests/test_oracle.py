"""Every query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pytest

import millrace.queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


# What needs more classes or values than this scale has is compared at a larger one.
@pytest.mark.parametrize("name", sorted(set(core.oracle_sql())))
def test_same_rows(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    r = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in r.description]
    want = r.fetchall()
    assert sorted(df.columns) == sorted(names)
    got = [tuple(map(plain, x)) for x in df.select(*[f"`{c}`" for c in names]).collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(plain, x)) for x in want), key=repr)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
