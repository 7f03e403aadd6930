"""Every registered query against its SQL, and plan properties they share."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from copyledger.registry import queries as registry
from tools.compare import canonical

# Those of the optional subpackage have tests of their own.
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


def check_plan(df):
    """No cross join, no Python, and one task only sees what an aggregate or a
    limit left over."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    lines = plan.splitlines()
    for i, text in enumerate(lines):
        if "Exchange SinglePartition" in text:
            below = lines[i + 1]
            assert "Aggregate" in below or "LocalLimit" in below or "TakeOrdered" in below, below


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    check_plan(df)
    got, expected = df.toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0
    assert canonical(got) == canonical(expected)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
