"""Rolling z-score detection, changepoints and anomaly windows.

Day-grain series are at most a few million rows by the calendar and use one
window. Row-grain series are numbered globally, cut into equal chunks with the
preceding rows copied into the next chunk, and scored chunk by chunk.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.numeric import number, number_or_null
from shiftlens.functions.ordering import backfill, ordered_rows, with_row_number
from shiftlens.operators.cohorts import tag, tag_from, window_summary
from shiftlens.session import materialize

Z_LIMIT = 2.5
ROW_WINDOW = 7
DAY_WINDOWS = (2, 3, 4, 5)
CHUNK_ROWS = 100_000


def time_bucket(date_col: str, grain: str | None = "day") -> Column:
    """The date value itself (None), its day, or its ``date_trunc`` at another grain."""
    if grain is None:
        return F.col(date_col)
    return F.to_date(date_col) if grain == "day" else F.date_trunc(grain, F.col(date_col).cast("timestamp"))


def daily_metric(df: DataFrame, date_col: str, metric: str, grain: str | None = "day") -> DataFrame:
    """Mean metric and row count per day, or per bucket of another grain, in the column ``day``."""
    return (
        df.filter(F.col(date_col).isNotNull())
        .groupBy(time_bucket(date_col, grain).alias("day"))
        .agg(F.avg(number(metric)).alias("metric_mean"), F.count(F.lit(1)).alias("n_rows"))
    )


def _rolling(window: Window, value: str, size: int) -> tuple[Column, Column]:
    """Mean and sample deviation over the ``size`` rows before the current one."""
    frame = window.rowsBetween(-size, -1)
    enough = F.count(value).over(frame) >= max(2, size // 2)
    return (
        F.when(enough, F.avg(value).over(frame)),
        F.when(enough, F.stddev_samp(value).over(frame)),
    )


def _fill_and_score(
    rolled: DataFrame, value: str, fill: dict[str, Column], z_limit: float = Z_LIMIT
) -> DataFrame:
    """Fill the warm-up, guard flat windows, then score and grade each point."""
    expected = F.coalesce(F.col("_mean"), fill["first_mean"], fill["series_mean"])
    raw = F.coalesce(F.col("_std"), fill["first_std"], fill["series_std"])
    series_std = F.coalesce(fill["series_std"], F.lit(0.0))
    usual = F.when(series_std > 0, series_std).otherwise(F.lit(1e-6))
    out = (
        rolled.withColumn("expected", expected)
        .withColumn("_spread", F.coalesce(raw, F.lit(0.0)))
        .withColumn(
            "spread",
            F.when(
                F.col("_spread") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("expected")), usual
            ).otherwise(F.col("_spread")),
        )
        .withColumn("z", (F.col(value) - F.col("expected")) / F.col("spread"))
    )
    size = F.abs("z")
    severity = (
        F.when(size < z_limit, "normal").when(size >= 4.0, "critical").when(size >= 3.0, "high").otherwise("medium")
    )
    return (
        out.withColumn("is_anomaly", size >= z_limit)
        .withColumn("severity", severity)
        .withColumn("anomaly_score", F.round(F.least(size / 5.0, F.lit(1.0)), 3))
        .withColumn("deviation_z", F.round("z", 2))
        .drop("_mean", "_std", "_spread")
    )


def score_series(series: DataFrame, order: str, value: str, size: int | None = None) -> DataFrame:
    """Points of a day-grain series; ``size`` None picks a quarter of it, 2 to 5.

    Fewer than five points give no rows.
    """
    ordered = Window.orderBy(order)
    whole = Window.partitionBy()
    back = Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.last("raw", ignorenulls=True).over(back), F.lit(0.0))
    out = series.withColumn("raw", F.col(value)).withColumn(value, filled)
    out = out.withColumn("row_number", F.row_number().over(ordered).cast("long")).withColumn(
        "_n", F.count(F.lit(1)).over(whole)
    )
    out = out.filter(F.col("_n") >= 5)
    mean, std = F.lit(None).cast("double"), F.lit(None).cast("double")
    quarter = F.floor(F.col("_n") / 4)
    wanted = F.lit(size) if size else F.greatest(F.lit(2), F.least(F.lit(5), quarter))
    for width in [size] if size else DAY_WINDOWS:
        rolled_mean, rolled_std = _rolling(ordered, value, width)
        mean = F.when(wanted == width, rolled_mean).otherwise(mean)
        std = F.when(wanted == width, rolled_std).otherwise(std)
    out = out.withColumn("_mean", mean).withColumn("_std", std)
    fill = {
        "first_mean": F.first("_mean", ignorenulls=True).over(all_rows),
        "first_std": F.first("_std", ignorenulls=True).over(all_rows),
        "series_mean": F.avg(value).over(whole),
        "series_std": F.stddev_samp(value).over(whole),
    }
    for name, column in fill.items():
        out = out.withColumn(f"_{name}", column)
    points = _fill_and_score(out, value, {name: F.col(f"_{name}") for name in fill})
    return points.drop("_n", *[f"_{name}" for name in fill])


def daily_points(df: DataFrame, date_col: str, metric: str, grain: str | None = "day") -> DataFrame:
    """Scored points of the daily mean, written down because several steps read them."""
    points = score_series(daily_metric(df, date_col, metric, grain), "day", "metric_mean")
    return materialize(points, "points")


def row_points(df: DataFrame, key: list[str], metric: str, size: int = ROW_WINDOW) -> DataFrame:
    """Scored points at row grain; ``key`` is a unique order, date first."""
    numbers = df.withColumn("raw", number_or_null(metric)).withColumn(metric, F.col("raw"))
    numbered = materialize(with_row_number(backfill(ordered_rows(numbers, key), metric)), "numbered")
    position = F.col("row_number") - 1
    chunk = F.floor(position / CHUNK_ROWS).cast("long")
    reaches_next = position % CHUNK_ROWS >= CHUNK_ROWS - size
    copies = F.when(reaches_next, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = numbered.withColumn("_home", chunk).withColumn("_chunk", F.explode(copies))
    mean, std = _rolling(Window.partitionBy("_chunk").orderBy("row_number"), metric, size)
    rolled = spread.withColumn("_mean", mean).withColumn("_std", std)
    start = max(2, size // 2) + 1
    first = rolled.filter((F.col("_chunk") == 0) & (F.col("row_number") == start))
    stats = numbered.agg(F.struct(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std")).alias("s"))
    rolled = (
        rolled.filter(F.col("_chunk") == F.col("_home"))
        .withColumn("_first", first.select(F.struct("_mean", "_std")).scalar())
        .withColumn("_stats", stats.scalar())
    )
    fill = {
        "first_mean": F.col("_first._mean"),
        "first_std": F.col("_first._std"),
        "series_mean": F.col("_stats.mean"),
        "series_std": F.col("_stats.std"),
    }
    scored = _fill_and_score(rolled, metric, fill).drop("_first", "_stats", "_home", "_chunk")
    return materialize(scored, "points")


def flagged(points: DataFrame) -> DataFrame:
    return points.filter("is_anomaly")


def changepoint(points: DataFrame) -> DataFrame:
    """One row: the most severe point and the start of its run of flagged points.

    The earliest point with the largest rounded |z| wins. The run starts after
    the last unflagged point before it. No row when nothing is flagged.
    """
    worst = F.max(F.struct(F.abs("deviation_z").alias("size"), (-F.col("row_number")).alias("negated")))
    peak = points.agg(F.when(F.bool_or("is_anomaly"), -worst["negated"]).alias("row")).first()["row"]
    before = ~F.col("is_anomaly") & (F.col("row_number") < F.lit(peak))
    return points.agg(
        F.lit(peak).cast("long").alias("peak_row"),
        (F.coalesce(F.max(F.when(before, F.col("row_number"))), F.lit(0)) + 1).alias("changepoint_row"),
        F.count(F.lit(1)).alias("n_points"),
    ).filter(F.col("peak_row").isNotNull())


def split_series(points: DataFrame) -> DataFrame:
    """Points with their period: before and from the changepoint, or flagged or not.

    The changepoint splits the series when three points precede it. Without any
    flagged point the period stays NULL.
    """
    found = changepoint(points).first()
    if found is None:
        return tag(points, F.lit(None).cast("boolean"))
    cut = found["changepoint_row"]
    return tag(points, F.col("row_number") >= cut if cut > 3 else F.col("is_anomaly"))


def series_window(points: DataFrame, label: str, metric: str) -> DataFrame:
    """Summary of the split series with the first and last label of each cohort.

    Means are taken over the values before gaps were filled.
    """
    split = split_series(points).withColumn("_label", F.col(label).cast("string"))
    base, anom = F.col("period") == "baseline", F.col("period") == "anomaly"
    key = F.col("row_number")

    def edge(pick, cohort: Column) -> Column:
        return pick(F.when(cohort, F.col("_label")), F.when(cohort, key))

    labels = split.agg(
        F.struct(
            F.concat(edge(F.min_by, base), F.lit(" to "), edge(F.max_by, base)).alias("baseline_label"),
            F.concat(edge(F.min_by, anom), F.lit(" to "), edge(F.max_by, anom)).alias("anomaly_label"),
            F.count_if("is_anomaly").alias("n"),
        ).alias("l")
    )
    summary = window_summary(split, "raw", "rolling_zscore").withColumn("l", labels.scalar())
    return (
        summary.withColumn("metric", F.lit(metric))
        .withColumn("baseline_label", F.col("l.baseline_label"))
        .withColumn("anomaly_label", F.col("l.anomaly_label"))
        .withColumn("flagged_points", F.col("l.n"))
        .filter(F.col("anomaly_count") > 0)
        .drop("l")
    )


def cutoff_day(points: DataFrame, mode: str = "first_flag") -> date | datetime | None:
    """The first flagged day, or with ``most_severe`` the day the worst run starts."""
    if mode == "first_flag":
        wanted = F.col("is_anomaly")
    else:
        found = changepoint(points).first()
        if found is None:
            return None
        wanted = F.col("row_number") == found["changepoint_row"]
    return points.agg(F.min(F.when(wanted, F.col("day"))).alias("day")).first()["day"]


def temporal_changepoint(df: DataFrame, date_col: str, cutoff: date | datetime | None) -> DataFrame:
    """Rows tagged by a cutoff; the cutoff itself belongs to the anomaly."""
    start = F.lit(cutoff).cast(df.schema[date_col].dataType)
    return tag_from(df, date_col, start)


def temporal_window(
    df: DataFrame, date_col: str, metric: str, points: DataFrame, mode: str = "first_flag"
) -> DataFrame:
    """Summary of the temporal split; empty unless both cohorts have five rows."""
    cutoff = cutoff_day(points, mode)
    tagged = temporal_changepoint(df, date_col, cutoff)
    n = points.agg(F.count_if("is_anomaly").alias("n")).scalar()
    return (
        window_summary(tagged, metric, "temporal_changepoint", n)
        .withColumn("baseline_label", F.lit(f"Baseline (< {cutoff})"))
        .withColumn("anomaly_label", F.lit(f"Anomaly Window (>= {cutoff})"))
        .filter((F.col("baseline_count") >= 5) & (F.col("anomaly_count") >= 5))
    )


def half_split(df: DataFrame, key: list[str]) -> DataFrame:
    """First half of the rows by key is baseline, the second half anomaly."""
    numbered = with_row_number(ordered_rows(df, key))
    half = df.agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    return tag(numbered, F.col("row_number") > half.scalar())


def fallback_window(df: DataFrame, key: list[str], metric: str, tagged: DataFrame | None = None) -> DataFrame:
    """Summary of the half split, for tables with too few complete rows."""
    return (
        window_summary(half_split(df, key) if tagged is None else tagged, metric, "fallback_split")
        .withColumn("baseline_label", F.lit("Baseline Cohort"))
        .withColumn("anomaly_label", F.lit("Comparison Cohort"))
    )


@dataclass
class Detected:
    """A found window: its one-row summary, the tagged rows and the scored points."""

    window: DataFrame
    tagged: DataFrame
    points: DataFrame


def rolling_window(
    df: DataFrame, date_col: str, metric: str, key: list[str], grain: str | None = "day"
) -> Detected | None:
    """Split at the grain when its buckets repeat, otherwise the row-grain split; None if nothing is flagged.

    Each decision reads one row or one count.
    """
    n = df.count()
    if n < 5:
        return None
    points = daily_points(df, date_col, metric, grain)
    days = points.count()
    if 5 <= days < n:
        window = materialize(temporal_window(df, date_col, metric, points), "window")
        if not window.isEmpty():
            return Detected(window, temporal_changepoint(df, date_col, cutoff_day(points)), points)
    points = row_points(df, [date_col, *key], metric)
    window = materialize(series_window(points, date_col, metric), "window")
    if window.isEmpty():
        return None
    tagged = split_series(points).withColumn(metric, F.col("raw")).select(*df.columns, "period")
    return Detected(window, tagged, points)


def fallback(df: DataFrame, key: list[str], metric: str) -> Detected:
    """Half split with no scored points."""
    tagged = half_split(df, key)
    return Detected(fallback_window(df, key, metric, tagged), tagged.select(*df.columns, "period"), df.limit(0))
