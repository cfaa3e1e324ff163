"""Driver contract: entry runs; every registered query builds and runs on
the smallest tables, a test each, without a cross product or a nested-loop
join; every oracle key is a query."""

import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = E.queries(), E.oracle_sql()


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 10000
    assert df.columns == ["k", "alpha", "n_mailed", "profit"]


def test_oracle_keys_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    df.limit(5).collect()
