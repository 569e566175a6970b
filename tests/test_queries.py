"""Each query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from notewright.oracle import ORACLES
from notewright.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value as both sides have it: no missing kinds, no widths of numbers, six decimals."""
    import numbers

    import pandas as pd

    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool":
        return str(v)
    return round(float(v), 6) if isinstance(v, numbers.Number) else v


def same(found, expected) -> None:
    """Equal columns and equal rows in any order."""

    def rows(frame):
        names = sorted(frame.columns)
        return names, sorted(repr(tuple(map(plain, r))) for r in frame[names].astype(object).itertuples(index=False))

    assert rows(found) == rows(expected)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_front_matter_of_any_number_of_lines(spark):
    from pyspark.sql import functions as F

    from notewright.operators.notes import front_matter

    long = "---\n" + "tag: x\n" * 100_000 + "---\nbody"
    cases = [long, long[:-9], "---\n---\n", "---\n---", "---\na: 1\n---", "---\na: 1\n--- \n---\nx", "---\na\n----\n", "--\n", "", None, " ---\n---\n", "---\na\n---x\n"]
    want = ["tag: x\n" * 100_000, None, "", "", "a: 1\n", "a: 1\n--- \n", None, None, None, None, None, None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content string")
    assert [r.block for r in rows.select("i", front_matter(F.col("content")).alias("block")).orderBy("i").collect()] == want
