"""Every registered query against its SQL, and rules its plan must keep."""

import pytest

import __spark_entry__ as contract
from check import compare, duck
from zonalpanel.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
CHECKS = registry.checks()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert compare(frame, con, CHECKS[name]) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(CHECKS)


def test_entry_has_rows(spark):
    frame = contract.entry(spark)
    assert "mean_CV" in frame.columns
    assert frame.count() == 25
