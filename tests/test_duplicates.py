"""Copies found by fingerprint: collisions, odd values, nested columns, shuffled bytes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import profiling


def counted(df):
    return tuple(profiling.duplicate_rows(df).first())


def test_copies_and_odd_values(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (None, "a", float("nan")), (None, "a", float("nan")), ("2", None, 1.0), (None, "2", 1.0), (None, None, None)]
    df = spark.createDataFrame([(None if r[0] is None else str(r[0]), r[1], r[2]) for r in rows], "x string, y string, z double")
    assert counted(df) == (7, 2, pytest.approx(200 / 7))
    assert counted(df.limit(0)) == (0, 0, 0.0)


def test_nested_columns_are_compared(spark):
    df = spark.createDataFrame([([1, 2],), ([2, 1],), ([1, 2],)], "v array<int>")
    assert counted(df)[:2] == (3, 1)


def test_colliding_fingerprints_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(profiling, "_fingerprint", lambda df: [F.lit(1).alias("_a"), (F.col("id") % 3).alias("_b")])
    df = spark.range(90).select((F.col("id") % 40).alias("id"), F.lit("t").alias("text"))
    assert counted(df)[:2] == (90, 50)


def test_whole_rows_are_not_shuffled(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("long text "), 200).alias("text"))
    plan = df.select(*profiling._fingerprint(df)).groupBy("_a", "_b").count()._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchange and all("text" not in line for line in exchange)
    assert counted(df)[:2] == (1000, 0)
