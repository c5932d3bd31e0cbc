"""Missing values, constants, ties and other odd input."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftlens.operators import cleaning, profiling
from shiftlens.operators import decomposition as dec
from shiftlens.operators import detection
from shiftlens.operators import hypotheses as hyp
from shiftlens.operators import statistics as st
from shiftlens.operators.cohorts import tag, tag_from, window_summary
from shiftlens.plans.investigation import investigate


def test_null_dates_are_in_neither_cohort(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01"), (3, None), (4, "garbage")], "id int, d string")
    df = cleaning.coerce_date(df, "d")
    got = {r["id"]: r["period"] for r in tag_from(df, "d", F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {1: "baseline", 2: "anomaly", 3: None, 4: None}


def test_nan_and_null_metrics_are_the_same(spark):
    rows = [(i, float(i % 5)) for i in range(40)]
    nan = spark.createDataFrame([*rows, (40, math.nan)], "id int, m double")
    null = spark.createDataFrame([*rows, (40, None)], "id int, m double")
    summaries = [window_summary(tag(d, F.col("id") >= 20), "m", "x").first() for d in (nan, null)]
    assert summaries[0] == summaries[1]
    assert summaries[0]["anomaly_count"] == 21


def test_null_segments_count_in_totals_only(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "s", 1.0) for i in range(40)], "id int, seg string, m double")
    rows = dec.decompose(tag(df, F.col("id") >= 20), "m", ["seg"]).collect()
    assert [r["segment_value"] for r in rows] == ["s"]
    assert rows[0]["share_base"] == pytest.approx(0.75)


def test_segment_on_one_side_uses_the_overall_mean(spark):
    data = [(i, "old" if i < 20 else "new", float(i)) for i in range(40)] + [(99, "old", 5.0)]
    df = tag(spark.createDataFrame(data, "id int, seg string, m double"), F.col("id") >= 20)
    row = {r["segment_value"]: r for r in dec.decompose(df, "m", ["seg"]).collect()}["new"]
    assert row["volume_base"] == 0
    assert row["rate_base"] == pytest.approx(np.mean(range(20)))


def test_integer_dimension_is_tested(spark):
    data = [(i, i % 2, (100.0 if i < 60 else 50.0) + i % 7) for i in range(120)]
    df = tag(spark.createDataFrame(data, "id int, won int, m double"), F.col("id") >= 60)
    long = dec.long_segments(df, "m", ["won"])
    tests = hyp.segment_tests(dec.decompose(df, "m", ["won"]), long).collect()
    assert {r["segment_value"] for r in tests} == {"0", "1"}
    assert all(r["status"] == "supported" for r in tests)


def verdict_of(spark, base, anom):
    frame = pd.DataFrame({"h": "h", "period": ["baseline"] * len(base) + ["anomaly"] * len(anom), "x": [*base, *anom]})
    long = spark.createDataFrame(frame)
    return st.verdict(st.two_sample(st.moments(long, ["h"]), long, ["h"])).first()


def test_flat_cohorts_with_different_means(spark):
    row = verdict_of(spark, [1.0] * 20, [2.0] * 20)
    assert row["statistic"] == math.inf and row["p_value"] == 0.0
    assert row["effect"] == 0.0 and row["status"] == "weak"


def test_flat_equal_cohorts(spark):
    row = verdict_of(spark, [1.0] * 20, [1.0] * 20)
    assert (row["statistic"], row["p_value"], row["status"]) == (0.0, 1.0, "rejected")


def test_tiny_cohort(spark):
    row = verdict_of(spark, [1.0, 2.0, 3.0] * 10, [5.0, 6.0])
    assert row["test_name"] == st.SMALL
    assert row["status"] == "inconclusive" and row["score"] == 15.0


def test_binary_metric_keeps_welch_though_skewed(spark):
    row = verdict_of(spark, [0.0] * 95 + [1.0] * 5, [0.0] * 90 + [1.0] * 10)
    assert row["test_name"] == st.WELCH
    row = verdict_of(spark, [0.0] * 95 + [1.0] * 4 + [2.0], [0.0] * 90 + [1.0] * 10)
    assert row["test_name"] == st.RANK_SUM


def test_constant_covariate(spark):
    data = [(i, 5.0, float(i % 9)) for i in range(60)]
    df = tag(spark.createDataFrame(data, "id int, c double, m double"), F.col("id") >= 30)
    row = hyp.covariate_tests(df, "m", ["c"]).first()
    assert row["r"] is None and row["r_p"] == 1.0
    assert row["rho"] is None and row["rho_p"] == 1.0
    assert row["status"] == "rejected"


def test_mostly_empty_covariate_is_left_out(spark):
    data = [(i, float(i) if i in (3, 40) else None, float(i % 9)) for i in range(60)]
    df = tag(spark.createDataFrame(data, "id int, c double, m double"), F.col("id") >= 30)
    assert hyp.covariate_tests(df, "m", ["c"]).count() == 0


def test_profile_of_odd_columns(spark):
    data = [(i, None, "k", f" v{i % 3} ") for i in range(30)]
    df = spark.createDataFrame(data, "n int, empty string, constant string, text string")
    counts = profiling.value_counts(df)
    types = {r["column"]: r for r in profiling.infer_types(df, counts).collect()}
    assert types["empty"]["inferred_type"] == "categorical" and types["empty"]["unique_count"] == 0
    assert types["constant"]["is_constant"]
    assert types["empty"]["missing_pct"] == 100.0
    roles = {(r["column"], r["role"]) for r in profiling.candidates(profiling.infer_types(df, counts)).collect()}
    assert ("text", "segment") in roles and ("constant", "segment") not in roles


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a")], "a int, b string")
    row = profiling.duplicate_rows(df).first()
    assert (row["duplicate_rows"], row["duplicate_pct"]) == (2, 50.0)


def test_trim_covers_all_whitespace(spark):
    text = " \t a b  \n"
    df = spark.createDataFrame([(text, 1)], "s string, n int")
    assert cleaning.trim_strings(df).first()["s"] == text.strip() == "a b"


def test_no_flags_gives_no_window(spark):
    frame = pd.DataFrame({"row_id": range(60), "d": pd.date_range("2024-01-01", periods=60), "m": [1.0, 2.0] * 30})
    assert detection.rolling_window(spark.createDataFrame(frame), "d", "m", ["row_id"]) is None


def test_flat_series_uses_the_floor(spark):
    frame = pd.DataFrame({"day": pd.date_range("2024-01-01", periods=12).date, "metric_mean": [3.0] * 12})
    points = detection.score_series(spark.createDataFrame(frame), "day", "metric_mean", 5)
    assert points.filter("is_anomaly").count() == 0


def test_short_series_has_no_points(spark):
    frame = pd.DataFrame({"day": pd.date_range("2024-01-01", periods=4).date, "metric_mean": [3.0, 4.0, 9.0, 1.0]})
    assert detection.score_series(spark.createDataFrame(frame), "day", "metric_mean").count() == 0


def test_column_names_with_dots_and_internal_names(spark):
    data = [(k, "ab"[k % 2], "pq"[k // 2 % 2], float(k % 5 + (k >= 30 and k % 2) * 4), float(k * 7 % 11)) for k in range(60)]
    df = spark.createDataFrame(data, "id int, `user.device` string, x string, `the.metric` double, y double")
    run = investigate(tag(df, F.col("id") >= 30), "the.metric", ["user.device", "x"], ["y"], "RUN-2")
    assert {r["dimension"] for r in run.contributions.collect()} == {"user.device", "x"}
    first = run.contributions.orderBy(F.desc(F.abs("contribution"))).first()
    assert (first["dimension"], first["segment_value"]) == ("user.device", "b")
    assert run.hypotheses.filter("dimension = 'y'").count() == 1


def test_the_cohort_column_is_no_dimension(spark):
    df = tag(spark.createDataFrame([(1, "a", 1.0)], "id int, seg string, m double"), F.col("id") >= 1)
    with pytest.raises(ValueError, match="period"):
        dec.decompose(df, "m", ["seg", "period"])


def test_limits_are_arguments(spark):
    data = [(k, f"s{k % 8}", float(k % 8 * (k >= 200) + k % 3)) for k in range(400)]
    df = tag(spark.createDataFrame(data, "id int, seg string, m double"), F.col("id") >= 200)
    run = investigate(df, "m", ["seg"], [], top_segments=8, max_scenarios=1)
    assert run.hypotheses.filter("family = 'segment_performance'").count() == 8
    assert run.scenarios.select("scenario_rank").distinct().count() == 1
