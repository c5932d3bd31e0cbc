"""Data under the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.numeric import number, ratio
from shiftlens.functions.selection import select_quantiles
from shiftlens.operators.cohorts import PERIOD, in_anomaly, in_baseline

BINS = 30


def chart_series(points: DataFrame, window: DataFrame) -> DataFrame:
    """Daily series with flags and the two cohort means as reference lines."""
    lines = window.select(F.struct("baseline_mean", "anomaly_mean").alias("w"))
    return points.withColumn("w", lines.scalar()).select(
        "day",
        F.col("raw").alias("metric_mean"),
        "is_anomaly",
        F.when(F.col("is_anomaly"), F.col("severity")).alias("flag_severity"),
        F.col("w.baseline_mean").alias("baseline_mean"),
        F.col("w.anomaly_mean").alias("anomaly_mean"),
    )


def chart_histogram(tagged: DataFrame, metric: str, bins: int = BINS) -> DataFrame:
    """Counts per cohort in equal bins over the common range."""
    rows = tagged.filter(F.col(PERIOD).isNotNull()).select(PERIOD, number(metric).alias("x"))
    rows = rows.filter(F.col("x").isNotNull())
    edges = rows.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("e"))
    width = (F.col("e.high") - F.col("e.low")) / F.lit(float(bins))
    place = F.floor(ratio(F.col("x") - F.col("e.low"), width))
    binned = rows.withColumn("e", edges.scalar()).withColumn(
        "bin", F.least(place, F.lit(bins - 1)).cast("int")
    )
    counted = binned.groupBy("bin").agg(
        F.count_if(in_baseline()).alias("baseline_count"), F.count_if(in_anomaly()).alias("anomaly_count")
    )
    return counted.withColumn("e", edges.scalar()).select(
        "bin", (F.col("e.low") + F.col("bin") * width).alias("bin_start"), "baseline_count", "anomaly_count"
    )


def chart_box(tagged: DataFrame, metric: str, segment: Column | None = None) -> DataFrame:
    """Five-number summary per cohort, within a segment; more than five rows needed."""
    rows = tagged.filter(F.col(PERIOD).isNotNull())
    if segment is not None:
        rows = rows.filter(segment)
    rows = rows.select(PERIOD, number(metric).alias("x"))
    enough = rows.agg((F.count(F.lit(1)) > 5).alias("ok"))
    cells = {"baseline": F.when(in_baseline(), F.col("x")), "anomaly": F.when(in_anomaly(), F.col("x"))}
    wanted = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return select_quantiles(rows, cells, wanted, PERIOD).filter(enough.scalar())
