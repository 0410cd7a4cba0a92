"""Physical plans: no cross joins, no Python workers, one scan where one is enough."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if n in entry.QUERIES}
# start streams or store tables while they are built; their plans are plain file scans
STORING = {"stream_dedupe", "stream_ingest"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STORING))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad


def test_columns_are_pruned(spark):
    plan = plan_of(QUERIES["tenant_row_counts"](spark, SF))
    assert "ReadSchema: struct<user_id:bigint>" in plan


@pytest.mark.parametrize("name", ["analytics_topk", "logs_search", "vector_topk"])
def test_limits_do_not_sort_everything(spark, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["analytics_count", "service_edges", "latency_histogram"])
def test_aggregates_are_partial_first(spark, name):
    assert "partial_" in plan_of(QUERIES[name](spark, SF))
