"""What the metric would be if a segment were back at its baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.numeric import ratio
from shiftlens.operators.decomposition import top_overall

MAX_SCENARIOS = 4
DEFAULT_VARIANCE = 0.01
CAVEATS = [
    "Assumes that the segment does not affect the others.",
    "Assumes that the baseline level would have lasted.",
    "A real fix may have side effects that this projection leaves out.",
]


def is_candidate() -> Column:
    """A primary driver, or a segment whose rate moved the metric's way."""
    dropped = (F.col("total_delta") < 0) & (F.col("rate_change") < 0)
    rose = (F.col("total_delta") >= 0) & (F.col("rate_change") > 0)
    return F.coalesce(F.col("is_primary") | dropped | rose, F.lit(False))


def scenario_candidates(contribs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Candidate segments, or all of them when none qualifies, of each run if ``keys`` names runs."""
    flagged = contribs.withColumn("is_candidate", is_candidate())
    some = flagged.groupBy(*keys).agg(F.coalesce(F.bool_or("is_candidate"), F.lit(False)).alias("some"))
    if keys:
        known = flagged.join(F.broadcast(some), [*keys])
        return known.filter(F.col("is_candidate") | ~F.col("some")).drop("is_candidate", "some")
    return flagged.filter(F.col("is_candidate") | ~some.scalar()).drop("is_candidate")


def restore(contribs: DataFrame) -> DataFrame:
    """Projected metric, recovery and 95 % interval per segment."""
    base = F.when(F.col("n_base") > 0, F.col("mean_base")).otherwise(F.col("rate_base"))
    anom = F.when(F.col("n_anom") > 0, F.col("mean_anom")).otherwise(F.col("rate_anom"))
    variance = [F.coalesce(F.col(f"var_{s}"), F.lit(DEFAULT_VARIANCE)) for s in ("base", "anom")]
    sizes = [F.greatest(F.col(f"n_{s}"), F.lit(2)) for s in ("base", "anom")]
    delta = F.col("share_anom") * (base - anom)
    gap = F.abs(F.col("overall_base") - F.col("overall_anom"))
    share = F.when(gap > 1e-9, ratio(F.abs("restoration_delta"), gap) * 100.0).otherwise(0.0)
    signed = F.when(
        gap > 1e-9, ratio(F.col("restoration_delta"), F.col("overall_base") - F.col("overall_anom")) * 100.0
    ).otherwise(0.0)
    margin = 1.96 * F.col("share_anom") * F.sqrt(variance[0] / sizes[0] + variance[1] / sizes[1])
    projected = F.col("overall_anom") + F.col("restoration_delta")
    return contribs.withColumn("restoration_delta", delta).withColumns({
        "observed_metric": F.col("overall_anom"),
        "projected_metric": projected,
        "recovery_pct": share,
        "signed_recovery_pct": signed,
        "ci_lower": projected - margin,
        "ci_upper": projected + margin,
        "scenario": F.format_string("Restore %s=%s", "dimension", "segment_value"),
        "caveats": F.array(*[F.lit(c) for c in CAVEATS]),
    })


def top_scenarios(contribs: DataFrame, k: int = MAX_SCENARIOS, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first k distinct candidate segments in order of impact."""
    distinct = scenario_candidates(contribs, keys).dropDuplicates([*keys, "dimension", "segment_value"])
    return restore(top_overall(distinct, k, keys)).withColumnRenamed("impact_rank", "scenario_rank")


def remediation_curve(scenarios: DataFrame) -> DataFrame:
    """Each scenario at 10 to 100 percent effect."""
    levels = scenarios.withColumn("effect_pct", F.explode(F.sequence(F.lit(10), F.lit(100), F.lit(10))))
    part = F.col("effect_pct") / 100.0
    return levels.select(
        "scenario_rank", "scenario", "effect_pct",
        (F.col("restoration_delta") * part).alias("scaled_delta"),
        (F.col("observed_metric") + F.col("restoration_delta") * part).alias("scaled_metric"),
        (F.col("recovery_pct") * part).alias("scaled_recovery_pct"),
        ((F.col("ci_upper") - F.col("projected_metric")) * part).alias("upper_margin"),
        ((F.col("projected_metric") - F.col("ci_lower")) * part).alias("lower_margin"),
    )
