"""Quantiles by selection against numpy, on ties, skew, gaps and bad pivots."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftlens.functions import selection
from shiftlens.functions.selection import select_quantiles
from shiftlens.operators import profiling

SHARES = {"low": 0.0, "p10": 0.1, "q1": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}


def frame(n: int = 4000) -> pd.DataFrame:
    """A third of ``hot`` is one value, ``sorted`` follows the tasks, ``rare`` is mostly missing."""
    random = np.random.default_rng(11)
    hot = np.where(random.random(n) < 0.34, 7.0, np.round(random.lognormal(1.5, 1.0, n), 2))
    rare = np.where(random.random(n) < 0.01, random.normal(0, 5, n), np.nan)
    return pd.DataFrame({"hot": hot, "sorted": np.arange(n) ** 1.5, "two": np.arange(n) % 2.0, "rare": rare})


def cells(df):
    return {c: F.nanvl(c, F.lit(None).cast("double")) for c in df.columns}


def check(df, rows: pd.DataFrame):
    got = {r["column"]: r for r in select_quantiles(df, cells(df), SHARES).collect()}
    assert set(got) == set(rows.columns)
    for name in rows:
        values = rows[name].dropna()
        assert got[name]["n_values"] == len(values)
        for label, share in SHARES.items():
            assert got[name][label] == pytest.approx(np.percentile(values, 100 * share), rel=1e-12), (name, label)


def test_quantiles_match_numpy(spark):
    rows = frame()
    check(spark.createDataFrame(rows), rows)


def test_groups_of_tasks_of_unequal_size(spark):
    rows = frame()
    df = spark.createDataFrame(rows)
    check(df.filter("sorted < 100").repartition(5).unionByName(df.filter("sorted >= 100").coalesce(1)), rows)


@pytest.mark.parametrize("pair", [(-1e9, -1e8), (7.0, 7.0), (1e9, 1e9), (0.5, 40.0)])
def test_pivots_never_change_results(spark, monkeypatch, pair):
    monkeypatch.setattr(selection, "_pivots", lambda wide, names, shares: {c: list(pair) * len(shares) for c in names})
    rows = frame(900)
    check(spark.createDataFrame(rows), rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_rows(spark, n):
    rows = pd.DataFrame({"x": [3.0, -1.0, 10.0][:n]})
    check(spark.createDataFrame(rows), rows)


def test_no_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert select_quantiles(df, {"x": F.col("x")}, SHARES).collect() == []
    assert select_quantiles(df.limit(0), {"x": F.col("x")}, SHARES).collect() == []
    assert select_quantiles(df, {}, SHARES).columns == ["column", "n_values", *SHARES]


def test_only_a_zone_of_each_column_is_shuffled(spark):
    df = spark.range(200000).select(F.rand(5).alias("x"), F.rand(6).alias("y"))
    df.write.mode("overwrite").format("noop").save()
    found = select_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, {"median": 0.5})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    pivots = selection._pivots(df, ["x", "y"], [0.5])
    for name, (low, high) in pivots.items():
        assert df.filter(F.col(name).between(low, high)).count() < 0.4 * df.count()
    assert found.count() == 2


def test_outliers_and_stats_of_few_values(spark):
    df = spark.createDataFrame([(1.0, True, "a"), (2.0, False, "b"), (None, None, None)], "x double, b boolean, t string")
    stats = {r["column"]: r for r in profiling.numeric_stats(df).collect()}
    assert set(stats) == {"x", "b"} and stats["x"]["median"] == 1.5 and stats["b"]["mean"] == 0.5
    out = {r["column"]: r for r in profiling.iqr_outliers(df).collect()}
    assert out["x"]["outlier_count"] == 0 and out["x"]["n_values"] == 2 and out["x"]["lower"] == 0.0
    assert profiling.iqr_outliers(df.select("t")).collect() == []
