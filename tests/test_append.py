"""Batches that the sink does not hold, few and many."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import skew
from logloom.streaming import pipeline


@pytest.mark.parametrize("few", [True, False])
def test_batches_not_yet_stored(spark, monkeypatch, few):
    batches = spark.createDataFrame(
        [(1, "a", 1), (1, "a", 1), (1, "b", 2), (2, "a", 3), (None, "a", 4), (None, "a", 4), (1, None, 5)], "tenant_id bigint, ingest_id string, n int")
    stored = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (3, "b")], "tenant_id bigint, ingest_id string")
    if not few:
        monkeypatch.setattr(skew, "LOOKUP_ROWS", 0)
        monkeypatch.setattr(pipeline, "fits", lambda df: False, raising=False)
    found = pipeline.not_yet_stored(batches, stored)
    assert sorted((r.tenant_id or 0, r.ingest_id or "", r.n) for r in found.collect()) == [(0, "a", 4), (1, "", 5), (1, "b", 2), (2, "a", 3)]


def test_many_batches_are_not_copied(spark):
    """Beyond the bound of a broadcast each key used to be copied 64 times."""
    batches = spark.range(skew.LOOKUP_ROWS + 10).select((F.col("id") % 3).alias("tenant_id"), F.col("id").cast("string").alias("ingest_id"))
    plan = pipeline.not_yet_stored(batches, batches.filter("tenant_id = 1"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1
