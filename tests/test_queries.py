"""Registered queries against their expected-result SQL on the small tables."""
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import rows
from guardtables.plans.derived import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

# These take a while to plan; check_queries.py runs them too.
SLOW = {
    "decision_rollup", "actions_by_control", "findings_rollup", "log_excerpts", "governed_calls", "flow_findings",
    "hostile_definitions", "robustness", "review_texts", "flow_shared_runs", "tool_call_checks", "tool_call_findings",
    "pending_approvals", "inspect_documents",
}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - SLOW))
def test_query(spark, con, name):
    got, want = queries()[name](spark, FOLDER).toPandas(), con.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert {"source", "action", "docs"} == set(entry(spark).columns)


def test_every_expectation_has_a_query():
    assert set(oracle_sql()) <= set(queries())
