"""Each query against its SQL in DuckDB over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    """Nullable integers come as floats from one side or the other, nulls as NaN."""
    if value is pd.NA:
        return None
    if isinstance(value, float):
        return None if value != value else int(value) if value.is_integer() else value
    return value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(plain, row))) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query(spark, duck, name):
    ours = entry_points.queries()[name](spark, FOLDER).toPandas()
    theirs = duck.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
