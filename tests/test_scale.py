"""Counts of a very large table, odd names and texts, finer time grains."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftlens.functions import pvalues
from shiftlens.functions.ordering import BUCKET, column_split_points, split_points
from shiftlens.operators import detection, isolation, profiling
from shiftlens.operators import statistics as st
from shiftlens.plans.investigation import detect_window
from shiftlens.sources import files


def test_chi_square_of_trillions(spark):
    volumes = [("d", "x", 10**12, 2 * 10**12), ("d", "y", 10**12, 10**12), ("d", "z", 3 * 10**12, 10**12)]
    df = spark.createDataFrame(volumes, "dimension string, segment_value string, volume_base long, volume_anom long")
    sides = [sum(v[k] for v in volumes) for k in (2, 3)]
    want = sum(
        (v[2 + k] - (v[2] + v[3]) * sides[k] / sum(sides)) ** 2 / ((v[2] + v[3]) * sides[k] / sum(sides))
        for v in volumes for k in (0, 1)
    )
    assert st.chi_square(df).first()["chi2"] == pytest.approx(want)


def test_moments_of_texts_that_are_flags(spark):
    rows = [("1", "x"), ("0", "1"), ("1", None), ("1", "y"), (None, None)]
    found = {r["column"]: r for r in profiling.moments(spark.createDataFrame(rows, "flag string, mixed string")).collect()}
    assert found["flag"]["n"] == 4 and found["flag"]["mean"] == 0.75 and found["flag"]["std"] == pytest.approx(0.5)
    assert found["mixed"]["n"] == 1 and found["mixed"]["std"] == 0.0


def test_rank_sum_counts_are_doubles(spark):
    rows = [("h", "baseline" if i % 2 else "anomaly", float(i % 5)) for i in range(200)]
    long = spark.createDataFrame(rows, "h string, period string, x double")
    plan = st.rank_sum(long, ["h"])._jdf.queryExecution().analyzed().toString()
    assert "cast(c_base" in plan and "cast(c_anom" in plan


def test_dates_are_judged_by_all_values(spark):
    rows = [(i, f"2024-01-{1 + i % 28:02d}" if i < 40 else f"junk {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "n int, update_day string")
    counts = profiling.value_counts(df)
    kinds = {r["column"]: r["inferred_type"] for r in profiling.infer_types(df, counts).collect()}
    assert kinds["update_day"] != "datetime"
    shares = {r["column"]: r["parsed_share"] for r in profiling.type_evidence(df, counts).collect()}
    assert shares["update_day"] == pytest.approx(0.2)


def test_zero_has_one_sign_and_names_may_hold_dots(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "b"), (1.0, "b")], "`unit.price` double, `user.kind` string")
    found = profiling.profile(df, ["`unit.price`"])
    rows = {r["column"]: r["unique_count"] for r in found.types.collect()}
    assert rows == {"unit.price": 2, "user.kind": 2}
    assert {r["column"] for r in found.stats.collect()} == {"unit.price"}


def test_forest_keeps_every_row(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 11), float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, m double, f double")
    found = detect_window(df, "m", ["id"])
    sizes = {r["period"]: r["count"] for r in found.tagged.groupBy("period").count().collect()}
    assert sum(sizes.values()) == 300 and sizes[None] == 100


def test_all_numeric_columns_are_features(spark):
    df = spark.createDataFrame([tuple(range(15))], [f"c{k}" for k in range(15)])
    assert len(isolation.default_features(df, "c0")) == 14


def test_hourly_step(spark):
    start = dt.datetime(2024, 3, 1)
    rows = [(i, start + dt.timedelta(hours=i // 4), 10.0 + (i * 7 % 5) / 10 + (20.0 if i // 4 >= 54 else 0.0)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, at timestamp, m double")
    found = detection.rolling_window(df, "at", "m", ["id"], grain="hour")
    window = found.window.first()
    assert window["anomaly_count"] == 24 and window["baseline_count"] == 216


def test_csv_keeps_texts(spark, tmp_path):
    texts = ['he said "yes", then', "two\nlines", "  padded  ", "", None, 'ends with "']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    files.write_csv(df, f"file:{tmp_path}/csv")
    back = files.read_csv(spark, f"file:{tmp_path}/csv", df.schema)
    assert [r["text"] for r in back.orderBy("id").collect()] == texts


def test_csv_is_split_unless_a_text_breaks_its_line(spark, tmp_path):
    whole = [(1, 'a "b" c'), (2, ""), (3, None), (4, "x, y"), (5, '"')]
    broken = [*whole, (6, "first\nsecond"), (7, '"\n"')]
    for name, rows, is_broken in (("whole", whole, False), ("broken", broken, True)):
        df = spark.createDataFrame(rows, "id int, text string")
        path = f"file:{tmp_path}/{name}"
        files.write_csv(df.coalesce(1), path)
        assert files.has_broken_lines(spark, path) == is_broken
        assert sorted(map(tuple, files.read_csv(spark, path, df.schema).collect())) == rows


def test_split_points_are_merged_in_two_levels(spark):
    df = spark.range(20000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("k"))
    for cuts in (split_points(df, "x")[None], column_split_points(df, {"x": F.col("x")})["x"], split_points(df, "x", "k")["1"]):
        steps = [b - a for a, b in zip(cuts, cuts[1:])]
        assert len(cuts) >= 10 and max(steps) < 3 * sum(steps) / len(steps)
    assert BUCKET


@pytest.mark.parametrize("df", [2e5, 9e5, 1.1e6, 5e6])
@pytest.mark.parametrize("t", [0.3, 1.9, 3.1, 6.0])
def test_t_is_one_function(t, df):
    by_fraction = pvalues.incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    assert pvalues.student_t_two_sided(t, df) == pytest.approx(by_fraction, rel=1e-6)
