"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip_whitespace(col: Column) -> Column:
    """Trim every kind of leading and trailing whitespace, not only blanks."""
    return F.trim(col, F.lit(WHITESPACE))
