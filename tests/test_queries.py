"""Every registered query against its SQL, on the smallest given tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from tablewright_queries.registry import REGISTRY, TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if value is None:
            return (1, "")
        return (0, "nan" if isinstance(value, float) and math.isnan(value) else repr(value))

    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        columns = [c[0] for c in result.description]
        assert _sorted_rows(df.columns, rows) == _sorted_rows(columns, result.fetchall())


def test_every_query_with_sql_is_registered():
    assert set(ORACLE) <= set(QUERIES)
    assert set(REGISTRY) <= set(ORACLE)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["category", "value"]
