"""Every registered query with a SQL text gives DuckDB's rows on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from tessella.plans.registry import ORACLES, QUERIES, flagship

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark):
    assert flagship(spark, FOLDER).limit(1).count() == 1


def test_entry_module_without_the_training_data_operators(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "tessella.llm", None)
    monkeypatch.setitem(sys.modules, "tessella.llm.queries", None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)
