"""The small scenarios: each finds what was planted."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import frames
from shiftlens.operators import decomposition as dec
from shiftlens.operators import detection, isolation, profiling
from shiftlens.operators import hypotheses as hyp
from shiftlens.operators import statistics as st
from shiftlens.operators.cohorts import tag
from shiftlens.operators.scenarios import restore, top_scenarios


def test_daily_step(spark):
    df = spark.createDataFrame(frames.daily_step())
    found = detection.rolling_window(df, "date", "yield_rate", ["row_id"])
    window = found.window.first()
    assert window["direction"] == "drop"
    assert window["relative_pct_change"] < -50.0
    assert found.points.filter("is_anomaly").count() > 0
    assert found.tagged.filter("period = 'anomaly'").count() == window["anomaly_count"]


def test_isolation_forest_finds_the_outliers(spark):
    df = spark.createDataFrame(frames.outliers())
    points = isolation.forest_points(df, "metric", ["row_id"], ["delay"])
    top = points.orderBy(F.desc("anomaly_score")).limit(3).toPandas()
    assert set(top["row_id"]) == {240, 241, 242}
    share = points.filter("is_anomaly").count() / 243
    assert 0.04 <= share <= 0.06
    window = isolation.forest_window(points, "metric").first()
    assert window["anomaly_count"] + window["baseline_count"] == 243


def test_isolation_forest_ignores_partitioning(spark):
    df = spark.createDataFrame(frames.outliers())
    scores = [
        {r["row_id"]: r["anomaly_score"] for r in isolation.forest_points(d, "metric", ["row_id"], ["delay"]).collect()}
        for d in (df.coalesce(1), df.repartition(9))
    ]
    assert scores[0] == scores[1]


def test_isolation_forest_matches_the_definition(spark):
    """Scores follow 2 ** -(mean path / c(n)): an isolated point has a short path."""
    assert isolation.average_path(2) == 1.0
    assert isolation.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_few_rows_fall_back_to_halves(spark):
    df = spark.createDataFrame(frames.outliers().head(15))
    assert isolation.forest_points(df, "metric", ["row_id"], ["delay"]) is None
    window = detection.fallback_window(df, ["row_id"], "metric").first()
    assert (window["baseline_count"], window["anomaly_count"]) == (7, 8)
    assert window["detection_method"] == "fallback_split"


def test_rate_drop(spark):
    df = tag(spark.createDataFrame(frames.rate_drop()), F.col("row_id") >= 150)
    rows = {r["segment_value"]: r for r in dec.decompose(df, "rate", ["pump"]).collect()}
    assert rows["north"]["is_primary"]
    assert rows["north"]["pct_of_total"] == pytest.approx(100.0)
    assert abs(rows["south"]["pct_of_total"]) < 1e-6
    assert not rows["south"]["is_primary"]


def test_types(spark):
    df = spark.createDataFrame(
        pd.DataFrame({
            "weight": [k * 0.75 for k in range(12)],
            "basin": ["upper", "lower", "middle"] * 4,
            "updated_on": [f"2022-11-{k + 3:02d}" for k in range(12)],
            "open_valve": [k % 3 % 2 for k in range(12)],
        })
    )
    types = {r["column"]: r["inferred_type"] for r in profiling.infer_types(df, profiling.value_counts(df)).collect()}
    assert types == {"weight": "numerical", "basin": "categorical", "updated_on": "datetime", "open_valve": "boolean"}


def test_iqr(spark):
    values = np.random.default_rng(5).normal(50, 5, 100)
    values[:2] = [500, -300]
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    row = profiling.iqr_outliers(df).first()
    q1, q3 = np.percentile(values, [25, 75])
    want = ((values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))).sum()
    assert row["outlier_count"] == want >= 2


def test_profile_candidates(spark):
    df = spark.createDataFrame(
        pd.DataFrame({
            "batch_key": [f"batch {i * 13 % 1009}" for i in range(130)],
            "poured_day": pd.date_range("2021-06-05", periods=130),
            "mould": [("oak", "ash", "elm")[i % 3] for i in range(130)],
            "load_score": [5 + i * 29 % 83 / 7 for i in range(130)],
        })
    )
    found = profiling.profile(df, ["batch_key"])
    assert found.names("metric") == ["load_score"]
    assert found.names("date") == ["poured_day"]
    assert found.names("segment") == ["mould"]


def two_groups(spark, base, anom):
    frame = pd.DataFrame({"h": "h", "period": ["baseline"] * len(base) + ["anomaly"] * len(anom), "x": [*base, *anom]})
    return spark.createDataFrame(frame)


def test_cohens_d(spark):
    long = two_groups(spark, [3.0, 3.4, 2.8, 3.3, 2.9, 3.1], [6.1, 6.6, 6.3, 5.9, 6.4, 6.2])
    assert st.effect_size(st.moments(long, ["h"])).first()["cohens_d"] > 5.0


def test_two_sample(spark):
    random = np.random.default_rng(9)
    long = two_groups(spark, random.normal(100, 5, 50), random.normal(50, 5, 50))
    row = st.verdict(st.two_sample(st.moments(long, ["h"]), long, ["h"]), F.lit(-1.0)).first()
    assert row["p_value"] < 0.001
    assert row["effect"] < -2.0
    assert row["status"] == "supported" and row["score"] > 70.0
    assert row["ci_low"] < row["mean_diff"] < row["ci_high"]


def test_mix_shift(spark):
    frame = pd.DataFrame({
        "row_id": range(200), "m": 1.0,
        "cat": ["A"] * 80 + ["B"] * 20 + ["A"] * 20 + ["B"] * 80,
    })
    df = tag(spark.createDataFrame(frame), F.col("row_id") >= 100)
    row = hyp.mix_tests(dec.segment_moments(dec.long_segments(df, "m", ["cat"]))).first()
    assert row["statistic"] == pytest.approx(69.62)
    assert row["effect"] == pytest.approx(0.59, abs=0.001)
    assert row["p_value"] < 0.001 and row["status"] == "supported"


# --- invariants --------------------------------------------------------------------


def parcel_fact(spark):
    df = spark.createDataFrame(frames.parcels())
    return tag(df, F.col("date") >= "2023-03-11")


def test_contributions_add_up(spark):
    rows = dec.decompose(parcel_fact(spark), "fee_amount", ["carrier", "region", "shift"]).toPandas()
    for _, part in rows.groupby("dimension"):
        assert part["contribution"].sum() == pytest.approx(part["total_delta"].iloc[0], abs=1e-9)
        assert part["share_base"].sum() == pytest.approx(1.0)
        assert part["share_anom"].sum() == pytest.approx(1.0)
        assert part["pct_of_total"].sum() == pytest.approx(100.0)
    identity = rows["share_anom"] * rows["rate_anom"] - rows["share_base"] * rows["rate_base"]
    assert np.allclose(rows["contribution"], identity)


def test_full_restoration_of_every_segment(spark):
    rows = restore(dec.decompose(parcel_fact(spark), "on_time", ["carrier"])).toPandas()
    assert np.allclose(rows["projected_metric"], rows["observed_metric"] + rows["restoration_delta"])
    assert (rows["ci_lower"] <= rows["projected_metric"]).all()
    assert (rows["projected_metric"] <= rows["ci_upper"]).all()


def test_scenarios_keep_the_first_four(spark):
    contribs = dec.decompose(parcel_fact(spark), "on_time", ["carrier", "region", "shift"])
    rows = top_scenarios(contribs).orderBy("scenario_rank").toPandas()
    assert list(rows["scenario_rank"]) == [1, 2, 3, 4][: len(rows)]
    assert rows["contribution"].abs().is_monotonic_decreasing


def test_rolling_points_match_pandas(spark):
    """Row-grain scores across several chunks equal a plain pandas rolling window."""
    random = np.random.default_rng(4)
    frame = pd.DataFrame({"row_id": range(700), "x": random.normal(10, 1, 700)})
    frame.loc[::41, "x"] = np.nan
    frame.loc[350, "x"] = 40.0
    old = detection.CHUNK_ROWS
    detection.CHUNK_ROWS = 50
    try:
        df = spark.createDataFrame(frame).repartition(5)
        got = detection.row_points(df, ["row_id"], "x").toPandas().sort_values("row_id")
    finally:
        detection.CHUNK_ROWS = old
    series = frame["x"].bfill().fillna(0)
    lagged = series.shift(1).rolling(7, min_periods=3)
    mean, std = lagged.mean().bfill(), lagged.std().bfill()
    assert np.allclose(got["expected"], mean)
    assert np.allclose(got["z"], (series - mean) / std)


def test_most_severe_cluster(spark):
    day0 = dt.date(2024, 1, 1)
    values = [10.0, 10.2, 9.9, 10.1, 10.0, 9.8, 10.1, 10.0, 30.0, 80.0, 81.0, 80.5, 81.2, 80.1]
    frame = pd.DataFrame({"day": [day0 + dt.timedelta(days=i) for i in range(14)], "metric_mean": values})
    points = detection.score_series(spark.createDataFrame(frame), "day", "metric_mean", 5)
    row = detection.changepoint(points).first()
    assert row["peak_row"] == 9 and row["changepoint_row"] == 9
    split = detection.split_series(points).groupBy("period").count().collect()
    assert {r["period"]: r["count"] for r in split} == {"baseline": 8, "anomaly": 6}
