"""Every registered query against its check SQL in DuckDB, on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import DATA

FOLDER = f"{DATA}/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def canon(columns, names, rows):
    order = [names.index(c) for c in columns]
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = canon(columns, df.columns, df.collect())
    assert got
    check = entry_points.oracle_sql().get(name)
    if check is not None:
        result = duck.sql(check)
        assert sorted(result.columns) == columns
        assert got == canon(columns, result.columns, result.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).columns == [
        "index", "email", "username", "domain", "confidence_score", "is_valid", "context"]
