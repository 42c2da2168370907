import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def con(sf):
    import duckdb
    connection = duckdb.connect()
    for name in "documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def documents(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, tied, repeated and very long texts."""
    passage = " ".join(f"shared{i}" for i in range(60))
    long = " ".join(f"w{i % 5000} v{i}" for i in range(40_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One TWO"), (5, "One TWO"), (6, passage),
            (7, "before " + passage + " after"), (8, passage), (8, passage), (8, "another text of this id " + passage),
            (9, long), (10, long + " end"), (11, "same " * 500), (None, "no id " + passage), (None, None),
            (12, "é ñ wide blank"), (13, "x" * 3000)]


@pytest.fixture
def odd(spark, odd_rows):
    """The same with extra columns whose names operators use inside."""
    rows = [(i, t, 1, "a", 2.0, 3, 4, 5, 6) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk int, digest string, score double, slot int, n int, size int, _row int")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
