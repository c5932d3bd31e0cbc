"""Cohorts: which rows are baseline, which are anomaly, and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.numeric import direction, number, percent_change

PERIOD = "period"
BASELINE = "baseline"
ANOMALY = "anomaly"


def in_baseline() -> Column:
    return F.col(PERIOD) == BASELINE


def in_anomaly() -> Column:
    return F.col(PERIOD) == ANOMALY


def tag(df: DataFrame, is_anomaly: Column) -> DataFrame:
    """User-specified window: TRUE is anomaly, FALSE is baseline, NULL is neither."""
    return df.withColumn(PERIOD, F.when(is_anomaly, ANOMALY).when(~is_anomaly, BASELINE))


def tag_from(df: DataFrame, date_col: str, cutoff: Column) -> DataFrame:
    """Rows from the cutoff on are the anomaly; rows without a date are in neither."""
    return tag(df, F.col(date_col) >= cutoff)


def window_from_totals(
    totals: DataFrame, metric: str | Column, method: str | Column, flagged: Column | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """One row, or one per run of ``keys``: cohort sizes, raw means, change, direction and method."""
    delta = F.col("anomaly_mean") - F.col("baseline_mean")
    return totals.select(
        *keys, F.lit(metric).alias("metric"),
        F.col("total_base").alias("baseline_count"),
        F.col("total_anom").alias("anomaly_count"),
        F.col("overall_base").alias("baseline_mean"),
        F.col("overall_anom").alias("anomaly_mean"),
    ).select(
        "*",
        delta.alias("absolute_delta"),
        percent_change(delta, F.col("baseline_mean")).alias("relative_pct_change"),
        direction(delta).alias("direction"),
        F.lit(method).alias("detection_method"),
        (flagged if flagged is not None else F.lit(0)).cast("long").alias("flagged_points"),
    )


def cohort_totals(tagged: DataFrame, metric: str) -> DataFrame:
    """One row with cohort sizes and means; reads the metric and the period only."""
    value = number(metric)
    return tagged.agg(
        F.count_if(in_baseline()).alias("total_base"),
        F.count_if(in_anomaly()).alias("total_anom"),
        F.avg(F.when(in_baseline(), value)).alias("overall_base"),
        F.avg(F.when(in_anomaly(), value)).alias("overall_anom"),
    )


def window_summary(
    tagged: DataFrame, metric: str, method: str, flagged: Column | None = None
) -> DataFrame:
    return window_from_totals(cohort_totals(tagged, metric), metric, method, flagged)
