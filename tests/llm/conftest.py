import pytest

from .helpers import corpus, frame


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def unique_rows(rows):
    """One row an id."""
    return list({r[0]: r for r in rows if r[0] is not None}.values())


@pytest.fixture(scope="session")
def unique(spark, unique_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark, unique_rows).write.parquet(path)
    return spark.read.parquet(path)
