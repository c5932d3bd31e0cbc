"""Null-safe arithmetic under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)


def named(name: str) -> Column:
    """The column by its whole name, which may hold a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(col: Column | str) -> Column:
    """Double value with NaN mapped to NULL, as missing values are one thing here."""
    value = (named(col) if isinstance(col, str) else col).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def number_or_null(col: Column | str) -> Column:
    """Number parsed from any type; text that is no number becomes NULL."""
    value = (named(col) if isinstance(col, str) else col).try_cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def ratio(top: Column, bottom: Column, default: float | None = 0.0) -> Column:
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def percent_change(delta: Column, base: Column) -> Column:
    return delta / (F.abs(base) + F.lit(1e-9)) * F.lit(100.0)


def direction(delta: Column) -> Column:
    return F.when(delta < 0, "drop").otherwise("spike")


def rounded(col: Column, digits: int) -> Column:
    """Output rounding; adding zero turns a negative zero into zero."""
    return F.round(col, digits) + F.lit(0.0)
