"""Every registered query against its SQL on the smallest tables, and what its plan may not hold."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference, oracle_connection
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tests.conftest import FOLDER



@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for word in ["CartesianProduct", "BroadcastNestedLoopJoin", "Python", "FullOuter"]:
        assert word not in plan, word
    assert difference(frame, connection, ORACLE[name]) is None


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
