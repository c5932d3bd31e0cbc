"""Report tables and report lines, one set per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATRIX_ROWS = 8
CONTRIBUTION_ROWS = 4
NO_DRIVER = "no single driver"
CAVEATS = [
    "Associations in the data; no proof of a cause.",
    "Factors that are not in the table may explain the change.",
    "Confirm with a rollback, a staged release or a holdout before costly action.",
]


def report_summary(window: DataFrame, hypotheses: DataFrame, run_id: str | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """One executive row per run: the change and its best supported explanation."""
    supported = hypotheses.filter(F.col("status") == "supported")
    best = supported.groupBy(*keys).agg(F.struct(F.min_by(F.struct("title", "score"), "rank").alias("h")).alias("b"))
    known = window.join(F.broadcast(best), [*keys], "left") if keys else window.withColumn("b", best.scalar())
    return known.select(
        F.lit(run_id).alias("run_id"),
        "metric", "baseline_mean", "anomaly_mean",
        F.abs("relative_pct_change").alias("abs_pct_change"),
        "direction", "detection_method",
        F.coalesce("b.h.title", F.lit(NO_DRIVER)).alias("primary_hypothesis"),
        F.col("b.h.score").alias("primary_score"),
    )


def report_contributions(top: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Text of the leading contributions, in order of impact."""
    mark = F.when(F.col("is_primary"), " [PRIMARY DRIVER]").otherwise("")
    return top.filter(F.col("impact_rank") <= CONTRIBUTION_ROWS).select(
        *keys,
        F.col("impact_rank").alias("line_no"),
        F.format_string(
            "%s = '%s'%s: %+.1f%% of the change, rate %.4f to %.4f (%+.4f)",
            F.col("dimension"), F.col("segment_value"), mark, F.col("pct_of_total"),
            F.col("rate_base"), F.col("rate_anom"), F.col("rate_change"),
        ).alias("text"),
    )


def report_matrix(hypotheses: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The best-ranked hypotheses with their first test and effect."""
    first = F.get("evidence", F.lit(0))
    effect = F.format_string(
        "%s=%+.2f", first["effect_name"], F.coalesce(first["effect"], F.lit(0.0))
    )
    return hypotheses.filter(F.col("rank") <= MATRIX_ROWS).select(
        *keys, "rank",
        F.upper("status").alias("status"),
        "title", "dimension", "score",
        F.coalesce(first["test_name"], F.lit("N/A")).alias("test_name"),
        F.coalesce(effect, F.lit("")).alias("effect"),
    )


def report_scenarios(scenarios: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return scenarios.select(
        *keys,
        F.col("scenario_rank").alias("line_no"),
        F.format_string(
            "%s: projected %.4f against observed %.4f, recovers %.1f%%, 95%% CI %.4f to %.4f",
            F.col("scenario"), F.col("projected_metric"), F.col("observed_metric"),
            F.col("recovery_pct"), F.col("ci_lower"), F.col("ci_upper"),
        ).alias("text"),
    )


def report_lines(
    summary: DataFrame, contributions: DataFrame, matrix: DataFrame, scenarios: DataFrame, run_id: str | Column
) -> DataFrame:
    """The whole report as (run_id, section, line_no, text)."""

    def section(rows: DataFrame, number: int, line: Column, text: Column) -> DataFrame:
        return rows.select(
            F.lit(run_id).alias("run_id"), F.lit(number).alias("section"),
            line.cast("int").alias("line_no"), text.alias("text"),
        )

    headline = F.format_string(
        "%s moved from %.4f to %.4f, a %.2f%% %s, found by %s; primary explanation: %s",
        F.col("metric"), F.col("baseline_mean"), F.col("anomaly_mean"), F.col("abs_pct_change"),
        F.col("direction"), F.col("detection_method"), F.col("primary_hypothesis"),
    )
    tested = F.format_string(
        "#%d %s | %s | %s | %.1f%% | %s (%s)",
        F.col("rank"), F.col("status"), F.col("title"), F.col("dimension"),
        F.col("score"), F.col("test_name"), F.col("effect"),
    )
    caveats = summary.select("run_id", F.posexplode(F.array(*[F.lit(c) for c in CAVEATS])))
    return (
        section(summary, 1, F.lit(1), headline)
        .unionByName(section(contributions, 2, F.col("line_no"), F.col("text")))
        .unionByName(section(matrix, 3, F.col("rank"), tested))
        .unionByName(section(scenarios, 4, F.col("line_no"), F.col("text")))
        .unionByName(section(caveats, 5, F.col("pos") + 1, F.col("col")))
    )


def audit_rows(window: DataFrame, hypotheses: DataFrame, run_id: str, started: Column) -> DataFrame:
    """Chronological log of what an investigation did, derived from its results."""
    detected = window.select(
        F.lit("Anomaly Detection").alias("step"),
        F.lit("Scan Completed").alias("action"),
        F.format_string(
            "%s: %.4f to %.4f (%+.1f%%)", F.col("detection_method"), F.col("baseline_mean"),
            F.col("anomaly_mean"), F.col("relative_pct_change"),
        ).alias("details"),
        F.lit(0).alias("seq"),
    )
    tested = hypotheses.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("Investigation Engine").alias("step"),
        F.lit("Analysis Completed").alias("action"),
        F.format_string("%d hypotheses tested", "n").alias("details"),
        F.lit(1).alias("seq"),
    )
    at = started + F.make_dt_interval(secs=F.col("seq"))
    return (
        detected.unionByName(tested)
        .select(
            F.lit(run_id).alias("run_id"), at.alias("at"), "step", "action", "details",
            F.lit("COMPLETED").alias("status"),
        )
        .orderBy("at")
    )
