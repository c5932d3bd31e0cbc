"""Cleaning: whitespace, dates, numbers, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.functions.dates import elect, read_date, readings
from shiftlens.functions.numeric import named, number_or_null
from shiftlens.functions.ordering import BUCKET, PLACE, backfill, ordered_rows
from shiftlens.functions.text import strip_whitespace


def trim_strings(df: DataFrame) -> DataFrame:
    """Strip leading and trailing whitespace of every string column."""
    return df.select(
        *[
            strip_whitespace(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def coerce_date(df: DataFrame, date_col: str) -> DataFrame:
    """Parse a text date in any of the ways of ``functions.dates``; other texts become NULL.

    Whether days or months come first is elected by all rows of the column in a
    subquery of one aggregate; nothing runs before the result is asked for.
    """
    if not isinstance(df.schema[date_col].dataType, T.StringType):
        return df
    text = strip_whitespace(named(date_col))
    counted = df.agg(*(c.alias(k) for k, c in readings(text, F.lit(1)).items()))
    day_first = elect(counted).select("is_day_first").scalar()
    return df.withColumn(date_col, read_date(text, day_first))


def coerce_number(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, number_or_null(column))


def clean(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """Trimmed strings and a parsed date. Order is left to the windows that need it."""
    out = trim_strings(df)
    return coerce_date(out, date_col) if date_col else out


def backfill_metric(df: DataFrame, key: list[str], metric: str) -> DataFrame:
    """Fill gaps from the next known value in key order, trailing gaps with zero."""
    numbers = coerce_number(df, metric)
    return backfill(ordered_rows(numbers, key), metric).drop(BUCKET, PLACE)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a number in every one of ``columns``."""
    return df.dropna(subset=columns)
