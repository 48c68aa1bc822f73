"""Every registered query against its SQL on the smallest data, and its plan."""

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tidemark.catalog.oracle import ORACLE
from tidemark.catalog.queries import QUERIES
from compare import duck, first_diff, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Joins with a side of exactly one row, or with a hand-written grid.
ONE_ROW_JOINS = {"scenario_grid", "dq_health", "audit_log_append", "audit_extract",
                 "dq_integrity_score", "rebase_dates"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(ORACLE[name])
    theirs = rows_of(result.columns, result.fetchall())
    assert sorted(df.columns) == sorted(result.columns)
    assert ours == theirs, first_diff(ours, theirs)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|CartesianProduct", text)
    if name not in ONE_ROW_JOINS:
        assert "BroadcastNestedLoopJoin" not in text


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 9 and "status" in df.columns
