"""Every registered query against its SQL twin on the same tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from jobtally.registry.oracle import SQL
from jobtally.registry.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [f[:-8] for f in sorted(os.listdir(SF_DIR)) if f.endswith(".parquet")]


FORBIDDEN = ["EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert QUERIES.items() <= driver.queries().items() and SQL.items() <= driver.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    wanted = multiset(columns, cursor.fetchall())
    assert sorted(got.columns) == sorted(columns)
    found = multiset(got.columns, [tuple(r) for r in got.collect()])
    missing, extra = wanted - found, found - wanted
    assert not missing and not extra, (
        f"{sum(missing.values())} missing, {sum(extra.values())} extra of {sum(wanted.values())}\n"
        f"{sorted(got.columns)}\nwanted {list(missing)[:2]}\nfound  {list(extra)[:2]}"
    )
    assert wanted


def test_entry(spark):
    assert driver.entry(spark).count() > 0
