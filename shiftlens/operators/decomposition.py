"""Rate and mix decomposition of a metric change.

One aggregate over (dimension, segment) carries every number later steps need:
volumes for the decomposition and the chi-square test, moments for the
two-sample test and the restoration scenarios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.numeric import named, number, ratio
from shiftlens.operators.cohorts import PERIOD, cohort_totals
from shiftlens.operators.statistics import moments

JOINT = " × "
WHOLE = "(all)"


def joint_column(first: str, second: str) -> Column:
    parts = [F.coalesce(named(c).cast("string"), F.lit("nan")) for c in (first, second)]
    return F.concat_ws(JOINT, *parts)


def long_segments(
    tagged: DataFrame, metric: str, dimensions: list[str], joint: bool = False, whole: bool = False
) -> DataFrame:
    """(period, x, dimension, segment_value): one Expand for all dimensions.

    ``joint`` adds the crossing of the first two dimensions as one more dimension,
    ``whole`` a dimension with a single segment, which carries the cohort totals.
    The column ``period`` is the cohort and cannot be a dimension.
    """
    if PERIOD in dimensions:
        raise ValueError(f"the column {PERIOD!r} holds the cohort; rename the dimension")
    columns = [named(d).cast("string").alias(d) for d in dimensions]
    listed = list(dimensions)
    if joint and len(dimensions) >= 2:
        listed.append(JOINT.join(dimensions[:2]))
        columns.append(joint_column(*dimensions[:2]).alias(listed[-1]))
    if whole:
        listed.append(WHOLE)
        columns.append(F.lit(WHOLE).alias(WHOLE))
    return (
        tagged.filter(F.col(PERIOD).isNotNull())
        .select(F.col(PERIOD).alias("_period"), number(metric).alias("_x"), *columns)
        .unpivot(["_period", "_x"], [named(c) for c in listed], "dimension", "segment_value")
        .withColumnsRenamed({"_period": PERIOD, "_x": "x"})
    )


def segment_moments(long: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Volumes and moments per segment, of each run if ``keys`` names runs; a missing segment value is no segment."""
    return moments(long.filter(F.col("segment_value").isNotNull()), [*keys, "dimension", "segment_value"], "volume")


def totals_row(segments: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cohort totals, one row per run, read from the ``whole`` dimension of a segment table."""
    return segments.filter(F.col("dimension") == WHOLE).select(
        *keys,
        F.col("volume_base").alias("total_base"),
        F.col("volume_anom").alias("total_anom"),
        F.col("mean_base").alias("overall_base"),
        F.col("mean_anom").alias("overall_anom"),
    )


def contributions(segments: DataFrame, totals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Shares, rates, rate and mix effect, contribution and the driver flag.

    ``keys`` name the run; its totals are one row per run, so they are broadcast.
    """
    one = totals.select(
        *keys, F.struct("total_base", "total_anom", "overall_base", "overall_anom").alias("t")
    )
    known = segments.join(F.broadcast(one), [*keys]) if keys else segments.withColumn("t", one.scalar())
    base_seen, anom_seen = F.col("volume_base") > 0, F.col("volume_anom") > 0
    shares = (
        known.filter((F.col("t.total_base") > 0) & (F.col("t.total_anom") > 0))
        .withColumns({
            "share_base": ratio(F.col("volume_base"), F.col("t.total_base")),
            "share_anom": ratio(F.col("volume_anom"), F.col("t.total_anom")),
            "rate_base": F.when(base_seen, F.col("mean_base")).otherwise(F.col("t.overall_base")),
            "rate_anom": F.when(anom_seen, F.col("mean_anom")).otherwise(F.col("t.overall_anom")),
            "overall_base": F.col("t.overall_base"),
            "overall_anom": F.col("t.overall_anom"),
        })
        .drop("t")
    )
    mean_share = (F.col("share_base") + F.col("share_anom")) / 2
    mean_rate = (F.col("rate_base") + F.col("rate_anom")) / 2
    rate_change = F.col("rate_anom") - F.col("rate_base")
    effects = shares.withColumns({
        "rate_change": rate_change,
        "rate_effect": mean_share * rate_change,
        "mix_effect": mean_rate * (F.col("share_anom") - F.col("share_base")),
        "total_delta": F.col("overall_anom") - F.col("overall_base"),
    }).withColumn("contribution", F.col("rate_effect") + F.col("mix_effect"))
    explained = F.when(
        F.abs("total_delta") > 1e-9, ratio(F.col("contribution"), F.col("total_delta")) * 100.0
    ).otherwise(0.0)
    driver = (F.abs(explained) >= 25.0) & (F.col("contribution") * F.col("total_delta") > 0)
    return effects.withColumns({"pct_of_total": explained, "is_primary": F.coalesce(driver, F.lit(False))})


def decompose(tagged: DataFrame, metric: str, dimensions: list[str], date_col: str | None = None) -> DataFrame:
    """Contributions of every segment of every dimension in one job."""
    wanted = [d for d in dimensions if d in tagged.columns and d not in (metric, date_col)]
    segments = segment_moments(long_segments(tagged, metric, wanted))
    return contributions(segments, cohort_totals(tagged, metric))


def impact_order() -> list[Column]:
    """Largest absolute contribution first, ties by name; unknown impact last."""
    size = F.abs("contribution")
    return [F.desc_nulls_last(size), F.asc("dimension"), F.asc("segment_value")]


def top_per_dimension(contribs: DataFrame, k: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    order = Window.partitionBy(*keys, "dimension").orderBy(*impact_order())
    return contribs.withColumn("impact_rank", F.row_number().over(order)).filter(F.col("impact_rank") <= k)


def leading(rows: DataFrame, order: list[Column], k: int, rank: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first k rows, of each run if ``keys`` names runs, with their rank; each task first keeps its own k."""
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn(rank, place).filter(F.col(rank) <= k)
    return rows.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_overall(contribs: DataFrame, k: int = 8, keys: tuple[str, ...] = ()) -> DataFrame:
    """The k largest contributions."""
    return leading(contribs, impact_order(), k, "impact_rank", keys)


def contribution_bars(contribs: DataFrame, direction: Column, k: int = 8) -> DataFrame:
    """Chart rows: label, share of the change, and whether it points the metric's way."""
    share = F.col("pct_of_total")
    along = ((share > 0) & (direction == "spike")) | ((share < 0) & (direction == "drop"))
    return top_overall(contribs, k).select(
        "impact_rank",
        F.concat_ws("=", "dimension", "segment_value").alias("label"),
        "pct_of_total",
        F.when(along, "red").otherwise("blue").alias("color_class"),
    )
