"""Ways of writing a date, the election of the order, and bad values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftlens.functions import dates
from shiftlens.operators import profiling
from shiftlens.operators.cleaning import clean

DAY = dt.datetime(2024, 3, 14)


@pytest.mark.parametrize(
    "text",
    ["2024-03-14", "2024-3-14", "2024/3/14", "2024.03.14", "20240314", "14 Mar 2024", "14-Mar-2024", "14th March 2024", "Mar 14, 2024",
     "March 14 2024", "mar. 14, 2024", "3/14/2024", "14/03/2024", "14.3.2024", "03-14-2024", " 2024-03-14 "],
)
def test_ways_of_writing(spark, text):
    rows = spark.createDataFrame([(text,)], "date string")
    assert clean(rows, "date").first()["date"] == DAY


@pytest.mark.parametrize("text", [None, "", "n/a", "10:30", "13/13/2024", "2024-02-30", "14 Foo 2024", "14 Anf 2024", "3/4", "99999999", "2024-13-01"])
def test_no_date(spark, text):
    assert clean(spark.createDataFrame([(text,)], "date string"), "date").first()["date"] is None


def test_times(spark):
    rows = spark.createDataFrame([("14.03.2024 9:05",), ("2024-03-14 09:05:07",), ("Mar 14, 2024 23:59",), ("20240314 01:02",)], "date string")
    got = {r["date"] for r in clean(rows, "date").collect()}
    assert got == {DAY.replace(hour=9, minute=5), DAY.replace(hour=9, minute=5, second=7), DAY.replace(hour=23, minute=59), DAY.replace(hour=1, minute=2)}


def test_one_number_above_twelve_settles_the_order(spark):
    texts = ["3/4/2024"] * 50 + ["1/2/2024"] * 50
    for extra, want in (("25/4/2024", dt.datetime(2024, 4, 3)), ("4/25/2024", dt.datetime(2024, 3, 4)), ("x", dt.datetime(2024, 3, 4))):
        rows = spark.createDataFrame([(t,) for t in [*texts, extra]], "date string").repartition(7)
        got = {r["date"] for r in clean(rows, "date").collect()}
        assert want in got


def test_share_of_bad_values_decides_the_type(spark):
    for bad, kind in ((4, "datetime"), (8, "text_id")):
        rows = spark.range(100).select(
            F.when(F.col("id") < bad, "bad").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "dd/MM/yyyy")).alias("order_date")
        )
        types = profiling.infer_types(rows, profiling.value_counts(rows)).first()
        assert (types["inferred_type"], types["is_day_first"]) == (kind, True)


def test_empty_column(spark):
    rows = spark.createDataFrame([(None,), (None,)], "date string")
    assert clean(rows, "date").filter("date IS NOT NULL").isEmpty()
    assert clean(rows.limit(0), "date").isEmpty()
    counted = dates.elect(rows.agg(*(c.alias(k) for k, c in dates.readings(F.col("date"), F.lit(1)).items()))).first()
    assert (counted["filled"], counted["parsed_count"], counted["is_day_first"]) == (0, 0, False)
