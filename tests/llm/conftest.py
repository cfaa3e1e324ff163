"""The awkward tables as Parquet, and the same tables empty."""

import pytest

from edge_tables import ROWS, SCHEMAS


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edge"))
    for name, rows in ROWS.items():
        spark.createDataFrame(rows(), SCHEMAS[name]).repartition(3).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ROWS:
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="session")
def duck(edge_dir):
    import duckdb

    c = duckdb.connect()
    for name in ROWS:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{edge_dir}/{name}.parquet/*.parquet'")
    return c
