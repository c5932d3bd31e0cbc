"""Dates written in many ways, read by one set of column expressions.

Most ways tell day and month apart by themselves: ISO forms, ``2024/3/14``, ``20240314``,
``14 Mar 2024`` and ``March 14, 2024``, each with an optional time. In ``3/4/2024``
the order is open. It is elected per column: the order that reads more rows wins, so one
number above 12 settles it; month first if no row tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first letters of the English months in their order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
TIME = r"((?:[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)"
ISO = r"^\d{4}-\d{1,2}(?:-\d{1,2}(?:[ T].*)?)?$"
YEAR_FIRST = rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){TIME}$"
COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}}){TIME}$"
DAY_NAME = rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ -]+([A-Za-z]{{3,9}})\.?,?[ -]+(\d{{4}}){TIME}$"
NAME_DAY = rf"^([A-Za-z]{{3,9}})\.? +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}}){TIME}$"
OPEN = rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){TIME}$"


def _rewritten(value: Column, pattern: str, form: str) -> Column:
    return F.when(value.rlike(pattern), F.try_to_timestamp(F.regexp_replace(value, pattern, form)))


def _with_name(value: Column, pattern: str, name: int, day: int) -> Column:
    part = lambda k: F.regexp_extract(value, pattern, k)
    place = F.position(F.lower(F.substring(part(name), 1, 3)), F.lit(MONTHS)) + 2
    month = F.when(place % 3 == 0, (place / 3).cast("int").cast("string"))
    return F.when(value.rlike(pattern), F.try_to_timestamp(F.concat(part(3), F.lit("-"), month, F.lit("-"), part(day), part(4))))


def plain_date(value: Column) -> Column:
    """Timestamp of a text that tells day and month apart, else NULL."""
    return F.coalesce(
        F.when(value.rlike(ISO), F.try_to_timestamp(value)),
        _rewritten(value, YEAR_FIRST, "$1-$2-$3$4"),
        _rewritten(value, COMPACT, "$1-$2-$3$4"),
        _with_name(value, DAY_NAME, 2, 1),
        _with_name(value, NAME_DAY, 1, 2),
    )


def open_date(value: Column, day_first: bool) -> Column:
    """Timestamp of a text such as ``3/4/2024`` in the given order."""
    return _rewritten(value, OPEN, "$3-$2-$1$4" if day_first else "$3-$1-$2$4")


def read_date(value: Column, day_first: Column) -> Column:
    return F.coalesce(plain_date(value), F.when(day_first, open_date(value, True)).otherwise(open_date(value, False)))


def readings(value: Column, weight: Column) -> dict[str, Column]:
    """Aggregates that count the rows each way of reading takes; combined map-side."""

    def taken(read: Column) -> Column:
        return F.coalesce(F.sum(F.when(read.isNotNull(), weight)), F.lit(0)).cast("long")

    return {
        "filled": F.coalesce(F.sum(F.when(value.isNotNull(), weight)), F.lit(0)).cast("long"),
        "plain": taken(plain_date(value)),
        "month_first": taken(open_date(value, False)),
        "day_first": taken(open_date(value, True)),
    }


def elect(counted: DataFrame) -> DataFrame:
    """The order and the rows read by it, from ``readings``."""
    chosen = F.col("day_first") > F.col("month_first")
    read = F.col("plain") + F.greatest("month_first", "day_first")
    return counted.withColumn("is_day_first", chosen).withColumn("parsed_count", read)
