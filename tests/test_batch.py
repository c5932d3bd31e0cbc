"""Many runs at once give what each run gives alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import frames
from shiftlens.operators.cohorts import tag
from shiftlens.plans.batch import Run, investigate_runs
from shiftlens.plans.investigation import investigate

DIMENSIONS, COVARIATES = ["carrier", "region"], ["scan_latency", "fee_amount"]


@pytest.fixture(scope="module")
def facts(spark):
    rows = spark.createDataFrame(frames.parcels(1500))
    hole = F.col("item_count") == 4
    return rows.withColumn("fee_amount", F.when(~hole, F.col("fee_amount"))).withColumn("date", F.when(F.col("parcel_key") != "P-000007-217", F.col("date")))


def runs():
    late = [F.col("date") >= day for day in ("2023-03-11", "2023-03-05")]
    return [Run("a", "on_time", late[0]), Run("b", "on_time", late[1]), Run("c", "fee_amount", late[0], "rolling")]


def test_batch_equals_single_runs(spark, facts):
    batch = investigate_runs(facts, runs(), DIMENSIONS, COVARIATES)
    lines = sorted(map(tuple, batch.lines.collect()))
    alone = []
    for run in runs():
        single = investigate(tag(facts, run.is_anomaly), run.metric, DIMENSIONS, COVARIATES, run.run_id)
        alone += [tuple(r) for r in single.lines.collect()]
    alone = [(*r[:3], r[3].replace("user_specified", "rolling") if r[0] == "c" else r[3]) for r in alone]
    assert lines == sorted(alone)
    again = batch.run("b")
    assert sorted(map(tuple, again.lines.collect())) == [r for r in lines if r[0] == "b"]
    assert again.nodes.count() > 0


def test_batch_without_cohorts(spark, facts):
    none = Run("n", "on_time", F.lit(None).cast("boolean"))
    batch = investigate_runs(facts.limit(50), [none], ["carrier"], [])
    assert batch.lines.count() == batch.hypotheses.count() == batch.window.count() == 0
    empty = investigate_runs(facts.limit(0), runs(), DIMENSIONS, COVARIATES)
    assert empty.lines.count() == 0


def test_batch_arguments(facts):
    with pytest.raises(ValueError, match="id of its own"):
        investigate_runs(facts, [runs()[0]] * 2, DIMENSIONS, COVARIATES)
    with pytest.raises(ValueError, match="dimensions"):
        investigate_runs(facts, [Run("a", "region", F.lit(True))], DIMENSIONS, COVARIATES)
