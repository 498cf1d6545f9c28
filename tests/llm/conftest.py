import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("the given tables are not here")
    return SF


@pytest.fixture(scope="session")
def con(sf):
    connection = duckdb.connect()
    for file in os.listdir(sf):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    return connection


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, source) rows, with columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, 7, 1, "x", [1.0]) for i, t, s in rows]
        ddl = (
            "doc_id bigint, text string, lang string, source string, size bigint, shard int, score string, "
            "_features array<double>"
        )
        return spark.createDataFrame(full, ddl)

    return make
