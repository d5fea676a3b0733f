"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan), plan
    got = df.toPandas()
    sql = oracle_sql().get(name)
    if sql is not None:
        assert difference(got, duck.execute(sql).df()) is None


def test_entry(spark):
    assert entry(spark).count() == 5
