"""Order without a single partition, on skewed and tied data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftlens.functions import ordering as o
from shiftlens.operators import statistics as st


def skewed(seed: int = 3, n: int = 3000) -> pd.DataFrame:
    """A third of all rows share one value; the rest are tied decimals."""
    random = np.random.default_rng(seed)
    x = np.where(random.random(n) < 0.34, 7.0, np.round(random.lognormal(1.5, 1.0, n), 1))
    return pd.DataFrame({"row_id": range(n), "g": random.choice(["a", "b"], n, p=[0.9, 0.1]), "x": x,
                         "y": np.round(x * random.random(n), 1)})


def test_quantiles_match_numpy(spark):
    frame = skewed()
    df = spark.createDataFrame(frame)
    counted = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    bucketed = o.in_buckets(counted, "x", o.split_points(df, "x", "g"), "g")
    shares = {"low": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {r["g"]: r for r in o.exact_quantiles(bucketed, ["g"], "x", "n", shares).collect()}
    for g, part in frame.groupby("g"):
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.percentile(part["x"], 100 * share), abs=1e-12)


def test_split_points_only_affect_balance(spark):
    df = spark.createDataFrame(skewed())
    counted = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    results = []
    for cuts in ([], [7.0], [-5.0, 0.0, 7.0, 7.5, 1000.0]):
        bucketed = o.in_buckets(counted, "x", {"a": cuts, "b": cuts}, "g")
        results.append(sorted(o.exact_quantiles(bucketed, ["g"], "x", "n", {"q": 0.37}).collect()))
    assert results[0] == results[1] == results[2]


def test_row_numbers_are_the_global_order(spark):
    frame = skewed()
    df = spark.createDataFrame(frame).repartition(7)
    got = o.with_row_number(o.ordered_rows(df, ["x", "row_id"])).toPandas()
    want = frame.sort_values(["x", "row_id"]).reset_index(drop=True)
    got = got.sort_values("row_number").reset_index(drop=True)
    assert list(got["row_number"]) == list(range(1, len(frame) + 1))
    assert list(got["row_id"]) == list(want["row_id"])


def test_backfill_crosses_buckets(spark):
    frame = pd.DataFrame({"row_id": range(500), "x": [np.nan] * 500})
    frame.loc[[3, 4, 410], "x"] = [1.0, 2.0, 3.0]
    df = spark.createDataFrame(frame).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = o.backfill(o.ordered_rows(df, ["row_id"]), "x").toPandas().sort_values("row_id")
    want = frame["x"].bfill().fillna(0.0)
    assert list(got["x"]) == list(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_rank_correlation_matches_pandas(spark, seed):
    frame = skewed(seed)
    df = spark.createDataFrame(frame)
    x_cuts, y_cuts = (o.split_points(df, c)[None] for c in ("x", "y"))
    placed = df.select(
        F.lit("c").alias("key"), "x", "y",
        o.bucket_of(F.col("x"), x_cuts, own_bucket=True).alias("bx"),
        o.bucket_of(F.col("y"), y_cuts, own_bucket=True).alias("by"),
    )
    got = st.spearman(placed, "key").first()
    want = frame["x"].rank().corr(frame["y"].rank())
    assert got["rho"] == pytest.approx(want, abs=1e-10)
    assert got["n_pairs"] == len(frame)


def test_frequent_values_get_their_own_bucket(spark):
    df = spark.createDataFrame(skewed())
    cuts = o.split_points(df, "x")[None]
    assert 7.0 in cuts
    placed = df.withColumn("b", o.bucket_of(F.col("x"), cuts, own_bucket=True))
    alone = placed.filter("b % 2 = 0").groupBy("b").agg(F.countDistinct("x").alias("n")).collect()
    assert alone and all(r["n"] == 1 for r in alone)
    largest = placed.filter("b % 2 = 1").groupBy("b").count().agg(F.max("count")).first()[0]
    assert largest < df.count() / 4


def test_mann_whitney_matches_pair_counts(spark):
    frame = skewed(5, 400)
    frame["period"] = np.where(frame["row_id"] % 3 == 0, "anomaly", "baseline")
    got = st.rank_sum(spark.createDataFrame(frame), ["g"]).collect()
    for row in got:
        part = frame[frame["g"] == row["g"]]
        a = part[part["period"] == "anomaly"]["x"].to_numpy()
        b = part[part["period"] == "baseline"]["x"].to_numpy()
        wins = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
        assert row["u_stat"] == wins
