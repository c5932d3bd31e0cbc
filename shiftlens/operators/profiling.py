"""Column profiling and role inference.

Distinct counts and top values come from one table of (column, value, count): a
single Expand, map-side counting, one shuffle. Moments, quartiles and outliers come
from wide aggregates over the data and never touch that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.functions import names
from shiftlens.functions.dates import elect, readings
from shiftlens.functions.numeric import NUMERIC_TYPES, number, ratio
from shiftlens.functions.selection import select_quantiles
from shiftlens.functions.text import strip_whitespace
from shiftlens.session import materialize

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def flat_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, NESTED_TYPES)]


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    if isinstance(field.dataType, DATE_TYPES):
        return "date"
    return "number" if isinstance(field.dataType, NUMERIC_TYPES) else "string"


def _quoted(field: T.StructField) -> Column:
    """The column by its whole name, which may hold a dot."""
    return F.col("`" + field.name.replace("`", "``") + "`")


def _named(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in flat_fields(df) if _kind(f) == kind]


def column_list(df: DataFrame) -> DataFrame:
    """One row per profiled column: name, position, kind of physical type."""
    rows = [(f.name, i, _kind(f), f.dataType.simpleString()) for i, f in enumerate(flat_fields(df))]
    return df.sparkSession.createDataFrame(
        rows, "column string, ordinal int, kind string, raw_type string"
    )


def as_text(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return (number(_quoted(field)) + F.lit(0.0)).cast("string").alias(field.name)
    return _quoted(field).cast("string").alias(field.name)


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, n) over all flat columns; NULL is a value of its own."""
    fields = flat_fields(df)
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    long = df.select(*[as_text(f) for f in fields]).unpivot(
        [], [_quoted(f) for f in fields], "column", "value"
    )
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def dataset_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and the total of missing cells."""
    missing = F.lit(0)
    for field in df.schema.fields:
        cell = number(_quoted(field)) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else _quoted(field)
        missing = missing + cell.isNull().cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("total_missing"),
    )


def _fingerprint(df: DataFrame) -> list[Column]:
    """128 bits over the flat columns; equal rows have equal ones, signs of zero and kinds of NaN set aside."""
    floats = (T.FloatType, T.DoubleType)
    flat = [_quoted(f) + F.lit(0.0) if isinstance(f.dataType, floats) else _quoted(f) for f in flat_fields(df)]
    missing = [F.concat(*(c.isNull().cast("string") for c in flat))] if flat else []
    return [F.xxhash64(F.lit(1), *flat).alias("_a"), F.xxhash64(F.lit(2), *missing, *flat, F.lit(3)).alias("_b")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that equal an earlier row, found by fingerprint and then verified.

    Only two hashes and a count per different row are shuffled. Rows whose fingerprint
    occurs once are no copies; the others are compared on all columns, so a collision
    of hashes changes nothing. The written list of shared fingerprints lets Spark
    choose its join by real size.
    """
    prints = _fingerprint(df)
    counted = materialize(df.select(*prints).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")), "fingerprints")
    shared = materialize(counted.filter("_n > 1").select("_a", "_b"), "shared-fingerprints")
    whole = F.struct(*(_quoted(f).alias(f"c{i}") for i, f in enumerate(df.schema.fields))).alias("_row")
    suspects = df.select(*prints, whole).join(shared, ["_a", "_b"], "left_semi")
    copies = suspects.groupBy("_a", "_b", "_row").agg(F.count(F.lit(1)).alias("_n"))
    extra = copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    out = extra.select(total.scalar().alias("n_rows"), "duplicate_rows")
    return out.withColumn("duplicate_pct", ratio(F.col("duplicate_rows"), F.col("n_rows")) * 100.0)


def column_counts(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Totals, missing and distinct counts per column, with the boolean-text check."""
    known = F.col("value").isNotNull()
    as_bool = F.when(
        F.col("column").isin(_named(df, "number")), F.col("value").try_cast("double").isin(0.0, 1.0)
    ).otherwise(F.col("value").isin(*names.BOOLEAN_TEXTS))
    summary = counts.groupBy("column").agg(
        F.sum("n").alias("total_count"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count_if(known).alias("unique_count"),
        F.coalesce(F.bool_and(F.when(known, as_bool)), F.lit(False)).alias("boolean_like"),
    )
    listed = column_list(df).join(summary, "column", "left").fillna(
        0, ["total_count", "missing_count", "unique_count"]
    )
    return listed.withColumn(
        "missing_pct", ratio(F.col("missing_count"), F.col("total_count")) * 100.0
    ).withColumn("is_constant", F.col("unique_count") <= 1)


DATE_SHARE = 0.95


def type_evidence(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Per column with a date name how many filled rows read as a date, and in which order, from all values.

    One aggregate over (column, value, count); physical dates read by definition.
    """
    dated = [f.name for f in flat_fields(df) if names.has_word(f.name, names.DATE_WORDS) and _kind(f) != "date"]
    text = strip_whitespace(F.col("value"))
    rows = counts.filter(F.col("column").isin(dated) & F.col("value").isNotNull())
    counted = rows.groupBy("column").agg(*(c.alias(k) for k, c in readings(text, F.col("n")).items()))
    share = ratio(F.col("parsed_count"), F.col("filled"))
    return elect(counted).withColumn("parsed_share", share).withColumnRenamed("filled", "read_from")


def infer_types(df: DataFrame, counts: DataFrame, date_share: float = DATE_SHARE) -> DataFrame:
    """Column counts with the semantic type; the first matching rule wins.

    A column with a date name is a date if at least ``date_share`` of its filled rows
    read as one; the rest are bad values, which cleaning turns into NULL.
    """
    evidence = type_evidence(df, counts)
    table = column_counts(df, counts).join(F.broadcast(evidence), "column", "left")
    table = table.fillna(0, ["parsed_count", "parsed_share"])
    filled = F.col("total_count") - F.col("missing_count")
    share = ratio(F.col("unique_count"), filled)
    parses = (F.col("parsed_count") > 0) & (F.col("parsed_share") >= date_share)
    id_named = names.name_has(F.col("column"), names.ID_WORDS)
    boolean = (F.col("kind") == "boolean") | (
        F.col("boolean_like") & (filled > 10) & (F.col("unique_count") <= 2)
    )
    inferred = (
        F.when(filled == 0, "categorical")
        .when(boolean, "boolean")
        .when((F.col("kind") == "date") | F.coalesce(parses, F.lit(False)), "datetime")
        .when((F.col("kind") == "number") & id_named & (share > 0.9), "text_id")
        .when(F.col("kind") == "number", "numerical")
        .when(id_named | ((share > 0.85) & (filled > 50)), "text_id")
        .when((F.col("unique_count") <= 100) | (share < 0.3), "categorical")
        .otherwise("text_id")
    )
    return table.withColumn("inferred_type", inferred).withColumn(
        "is_id_candidate", (F.col("inferred_type") == "text_id") | id_named
    )


def numeric_cells(df: DataFrame) -> dict[str, Column]:
    """Column name -> double: numbers, booleans, and texts that are 0 or 1; anything else is NULL."""
    cells = {}
    for f in flat_fields(df):
        kind, cell = _kind(f), _quoted(f)
        if kind == "number":
            cells[f.name] = number(cell)
        elif kind == "boolean":
            cells[f.name] = cell.cast("int").cast("double")
        elif kind == "string":
            cells[f.name] = F.when(cell.isin("0", "1"), cell.try_cast("double"))
    return cells


def moments(df: DataFrame) -> DataFrame:
    """n, min, max, mean and sample deviation per column that holds numbers, in one pass."""
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.count(value).alias("n"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.avg(value).alias("mean"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        )
        for name, value in numeric_cells(df).items()
    ]
    if not rows:
        return df.sparkSession.createDataFrame(
            [], "column string, n bigint, min double, max double, mean double, std double"
        )
    return df.agg(F.array(*rows).alias("stats")).select(F.inline("stats")).filter(F.col("n") > 0)


def quartiles(df: DataFrame) -> DataFrame:
    """Exact quartiles of every column that holds numbers, by selection on the wide table."""
    return select_quantiles(df, numeric_cells(df), {"q1": 0.25, "median": 0.5, "q3": 0.75})


def numeric_stats(df: DataFrame, quarters: DataFrame | None = None) -> DataFrame:
    """Moments and quartiles per column that holds numbers."""
    quarters = quartiles(df) if quarters is None else quarters
    return (
        moments(df).join(F.broadcast(quarters.drop("n_values")), "column")
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    )


def iqr_outliers(df: DataFrame, quarters: DataFrame | None = None) -> DataFrame:
    """Values strictly outside the quartile fences, counted in one pass; five values needed.

    The fences are one row per column and enter the count as literals.
    """
    cells = numeric_cells(df)
    rows = []
    for q in (quartiles(df) if quarters is None else quarters).collect():
        enough = q["n_values"] >= 5
        reach = (q["q3"] - q["q1"]) * 1.5
        lower, upper = (q["q1"] - reach, q["q3"] + reach) if enough else (0.0, 0.0)
        value = cells[q["column"]]
        rows.append(
            F.struct(
                F.lit(q["column"]).alias("column"),
                F.lit(lower).alias("lower"),
                F.lit(upper).alias("upper"),
                F.lit(q["n_values"]).cast("long").alias("n_values"),
                F.count_if(F.lit(enough) & ((value < lower) | (value > upper))).alias("outlier_count"),
            )
        )
    if not rows:
        return df.sparkSession.createDataFrame(
            [], "column string, lower double, upper double, n_values long, outlier_count long, outlier_pct double"
        )
    return df.agg(F.array(*rows).alias("fences")).select(F.inline("fences")).withColumn(
        "outlier_pct", ratio(F.col("outlier_count"), F.col("n_values")) * 100.0
    )


def top_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent values per column; each task first keeps only its own top k."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = counts.filter(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def candidates(types: DataFrame) -> DataFrame:
    """(column, role, priority, ordinal) for date, metric and segment columns."""
    kind = F.col("inferred_type")
    is_metric = kind.isin("numerical", "boolean") & ~F.col("is_constant") & ~F.col("is_id_candidate")
    is_segment = (
        kind.isin("categorical", "boolean")
        & F.col("unique_count").between(2, 80)
        & ~F.col("is_id_candidate")
    )
    name = F.col("column")
    metric_priority = (
        F.when(names.name_has(name, names.FIRST_METRIC_WORDS), 0)
        .when(names.name_has(name, names.SECOND_METRIC_WORDS), 1)
        .otherwise(2)
    )
    segment_priority = F.when(names.name_has(name, names.FIRST_SEGMENT_WORDS), 0).otherwise(1)
    roles = F.array(
        F.when(kind == "datetime", F.struct(F.lit("date").alias("role"), F.lit(0).alias("priority"))),
        F.when(is_metric, F.struct(F.lit("metric").alias("role"), metric_priority.alias("priority"))),
        F.when(is_segment, F.struct(F.lit("segment").alias("role"), segment_priority.alias("priority"))),
    )
    return (
        types.withColumn("r", F.explode(F.array_compact(roles)))
        .select("column", "r.role", "r.priority", "ordinal")
        .orderBy("role", "priority", "ordinal")
    )


def schema_health(types: DataFrame, stats: DataFrame, outliers: DataFrame, top: DataFrame) -> DataFrame:
    """Display table: one row per column with its mean or its first two values."""
    leading = top.filter(F.col("rank") <= 2).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("_top")
    )
    joined = (
        types.join(stats.select("column", "mean"), "column", "left")
        .join(outliers.select("column", "outlier_count", "outlier_pct"), "column", "left")
        .join(leading, "column", "left")
    )
    counted = F.col("inferred_type").isin("numerical", "boolean")
    listed = F.col("inferred_type").isin("categorical", "boolean")
    shown_top = F.concat(F.lit("["), F.array_join("_top.value", ", "), F.lit("]"))
    shown = F.when(counted & F.col("mean").isNotNull(), F.format_string("%.4f", F.col("mean"))).when(
        listed & F.col("_top").isNotNull(), shown_top
    ).otherwise("[]")
    n_out = F.coalesce(F.when(counted, F.col("outlier_count")), F.lit(0))
    pct_out = F.coalesce(F.when(counted, F.col("outlier_pct")), F.lit(0.0))
    return joined.select(
        "column",
        F.upper("inferred_type").alias("inferred_type"),
        F.format_string("%.2f%% (%d)", F.col("missing_pct"), F.col("missing_count")).alias("missing"),
        F.col("unique_count").alias("uniques"),
        F.format_string("%d (%.2f%%)", n_out, pct_out).alias("outliers"),
        shown.alias("mean_or_top"),
    )


def measured(df: DataFrame, types: DataFrame) -> DataFrame:
    """The columns of ``df`` that are measured, numerical and boolean ones; one row per column is read."""
    kept = {r["column"] for r in types.filter(F.col("inferred_type").isin("numerical", "boolean")).collect()}
    return df.select(*[_quoted(f) for f in flat_fields(df) if f.name in kept])


@dataclass
class Profile:
    """Profile tables of one dataset; the value counts behind them are written once."""

    types: DataFrame
    stats: DataFrame
    outliers: DataFrame
    top: DataFrame
    candidates: DataFrame

    def names(self, role: str) -> list[str]:
        """Candidate column names of a role; at most one row per column is read."""
        return [r["column"] for r in self.candidates.collect() if r["role"] == role]


def profile(df: DataFrame, key: list[str]) -> Profile:
    counts = materialize(value_counts(df), "value-counts")
    types = materialize(infer_types(df, counts), "column-types")
    numbers = measured(df, types)
    quarters = materialize(quartiles(numbers), "quartiles")
    return Profile(
        types=types,
        stats=numeric_stats(numbers, quarters),
        outliers=iqr_outliers(numbers, quarters),
        top=top_values(counts).join(
            F.broadcast(types.filter(F.col("inferred_type").isin("categorical", "boolean")).select("column")),
            "column",
        ),
        candidates=candidates(types),
    )
