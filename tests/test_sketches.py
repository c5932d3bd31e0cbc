"""Mergeable states and heavy hitters against exact counts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import sketches
from shiftlens.operators.profiling import top_values, value_counts


@pytest.fixture(scope="module")
def rows(spark):
    """A hot value, few values, a long tail, nothing but single values, nothing at all."""
    i = F.col("id")
    return spark.range(6000).select(
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(400)))).alias("hot"),
        (i % 4).alias("few"),
        F.when(i % 10 != 0, F.nanvl(F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(F.floor(F.sqrt(i))), F.lit(None))).alias("tail"),
        i.cast("string").alias("single.id"),
        F.lit(None).cast("string").alias("nothing"),
    )


def plain(df):
    return sorted((r["column"], r["rank"], r["value"], r["n"]) for r in df.collect())


@pytest.mark.parametrize(("tracked", "most"), [(8, 80), (64, 64), (1000, 10000), (10, 5)])
def test_frequent_values_are_exact(spark, rows, tracked, most):
    got = sketches.frequent_values(rows, rows.columns, 5, tracked, most)
    assert plain(got) == plain(top_values(value_counts(rows), 5))


def test_frequent_values_of_nothing(spark, rows):
    assert sketches.frequent_values(rows.limit(0), ["hot", "few"]).collect() == []
    assert sketches.frequent_values(rows, []).collect() == []


def test_states_add_up(spark, rows):
    parts = [sketches.column_state(rows.filter(F.col("few") == k)) for k in range(4)]
    parts.append(sketches.column_state(rows.select("few", F.lit("x").alias("late"))))
    got = {r["column"]: r for r in sketches.distinct_estimates(sketches.merge_states(*parts)).collect()}
    for name in rows.columns:
        exact = rows.select(F.count_distinct(F.nanvl(F.col("`tail`"), F.lit(None)) if name == "tail" else F.col(f"`{name}`"))).first()[0]
        assert abs(got[name]["unique_estimate"] - exact) <= got[name]["error_share"] * exact, name
        assert got[name]["total_count"] == (12000 if name == "few" else 6000)
    assert got["nothing"]["missing_count"] == 6000 and got["late"]["unique_estimate"] == 1


def test_state_of_no_rows(spark, rows):
    got = sketches.distinct_estimates(sketches.column_state(rows.limit(0))).collect()
    assert len(got) == len(rows.columns)
    assert {(r["total_count"], r["unique_estimate"]) for r in got} == {(0, 0)}
    assert sketches.column_state(rows.select()).collect() == []
