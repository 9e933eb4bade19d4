"""Lookups leave the join strategy to Spark: a small dimension is broadcast by
its size in bytes, a large one is shuffled, and building a lookup runs no job."""

import pytest

from wayfare.operators.joins import lookup


def _lookup(spark, n):
    dim = spark.range(n).selectExpr("id AS k", "concat('name', id) AS name", "id AS ord")
    return lookup(spark.range(1000).withColumnRenamed("id", "code"), dim, "code", "k", "name", "out")


@pytest.fixture()
def threshold(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = [spark.conf.get(k, None) for k in keys]
    yield lambda v: [spark.conf.set(k, v) for k in keys]
    for k, v in zip(keys, old):
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_small_dimension_is_broadcast_at_run_time(spark, threshold):
    threshold("1m")
    assert "BroadcastHashJoin" in _final_plan(_lookup(spark, 10))


def test_large_dimension_is_shuffled(spark, threshold):
    threshold("1k")
    plan = _final_plan(_lookup(spark, 5000))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_building_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "lookups only")
    try:
        _lookup(spark, 10)
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
