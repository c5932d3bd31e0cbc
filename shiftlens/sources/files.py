"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Quotes are doubled inside quotes, blanks belong to the text, and only an unquoted
# empty field is NULL, on both sides.
EMPTY_MARK = "\x01"  # what the reader gives for an empty text in quotes
CSV_FORM = {
    "header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """True if a quoted text may run over a line break: the line it starts on has an odd number of quotes.

    One scan that can be split at any line and ends at the first such line.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit(CSV_FORM["quote"]), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool | None = None
) -> DataFrame:
    """CSV with a header. Give a schema at scale: inference reads the input twice.

    Texts may hold line breaks. Files in which one does can only be read by one task
    each; all others are split. Which it is a scan of the quotes tells, unless
    ``multi_line`` says so.
    """
    multi_line = has_broken_lines(spark, path) if multi_line is None else multi_line
    reader = spark.read.options(**{**CSV_FORM, "emptyValue": EMPTY_MARK}, multiLine=multi_line)
    rows = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.replace(EMPTY_MARK, "", texts) if texts else rows


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_FORM).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def preview(df: DataFrame, key: list[str], rows: int = 15) -> DataFrame:
    """First rows in key order; a per-partition top-k, not a full sort."""
    return df.orderBy(*key).limit(rows)


def write_text(lines: DataFrame, path: str) -> None:
    """Write the ``text`` column of report lines, one folder per run."""
    lines.select("run_id", "text").write.partitionBy("run_id").text(path)
