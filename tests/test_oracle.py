"""Every registered query with SQL agrees with it; the others return rows."""

import duckdb
import pytest

from rankforge.plans import REGISTRY
from tools.check_queries import TABLES, compare


@pytest.fixture(scope="session")
def con(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, name, sf)
    assert ok, note
