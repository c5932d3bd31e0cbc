"""From a tagged fact table to ranked hypotheses, scenarios, graph and report."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.numeric import named
from shiftlens.operators import decomposition as dec
from shiftlens.operators import hypotheses as hyp
from shiftlens.operators import isolation, report
from shiftlens.operators.cohorts import tag, window_from_totals
from shiftlens.operators.detection import Detected, fallback, rolling_window
from shiftlens.operators.evidence import graph_edges, graph_nodes
from shiftlens.operators.scenarios import MAX_SCENARIOS, remediation_curve, top_scenarios
from shiftlens.session import materialize
from shiftlens.sources.history import RunStore


def detect_window(
    df: DataFrame, metric: str, key: list[str], date_col: str | None = None, grain: str | None = "day"
) -> Detected:
    """Rolling z-score when a date column flags something, otherwise isolation forest."""
    if date_col:
        found = rolling_window(df, date_col, metric, key, grain)
        if found is not None:
            return found
    points = isolation.forest_points(df, metric, key)
    if points is None:
        return fallback(df, key, metric)
    flags = tag(points, F.col("is_anomaly")).select(*key, "period")
    tagged = df.join(flags, key, "left").select(*df.columns, "period")
    return Detected(isolation.forest_window(points, metric), tagged, points)


DETAILS = ("window", "segments", "contributions", "hypotheses", "scenarios")


@dataclass
class Investigation:
    """Result tables of one run, already written. A run rebuilt from the history has no ``tagged`` rows."""

    run_id: str
    tagged: DataFrame | None
    window: DataFrame
    segments: DataFrame
    contributions: DataFrame
    hypotheses: DataFrame
    scenarios: DataFrame

    @property
    def curve(self) -> DataFrame:
        return remediation_curve(self.scenarios)

    @property
    def nodes(self) -> DataFrame:
        return graph_nodes(self.hypotheses)

    @property
    def edges(self) -> DataFrame:
        return graph_edges(self.hypotheses)

    @property
    def summary(self) -> DataFrame:
        return report.report_summary(self.window, self.hypotheses, self.run_id)

    @property
    def lines(self) -> DataFrame:
        return report.report_lines(
            self.summary,
            report.report_contributions(dec.top_overall(self.contributions)),
            report.report_matrix(self.hypotheses),
            report.report_scenarios(self.scenarios),
            self.run_id,
        )

    def audit(self, started: Column) -> DataFrame:
        return report.audit_rows(self.window, self.hypotheses, self.run_id, started)

    def run_row(self, title: str, dataset: str, created_at: Column, date_col: str | None = None) -> DataFrame:
        """One nested row for the history table.

        Every list in it is bounded by the number of dimension and covariate columns:
        hypotheses are the leading segments of each dimension, scenarios and lines are
        few. Contributions, one per segment, are not in it; see ``details``.
        """

        def listed(rows: DataFrame, order: list[Column]) -> Column:
            packed = rows.select(F.struct(*order, *rows.columns).alias("r"))
            return packed.agg(F.array_sort(F.collect_list("r")).alias("rows")).scalar()

        def label(name: str) -> Column:
            known = F.col(name) if name in self.window.columns else F.lit(None)
            return known.cast("string").alias(name)

        lines = materialize(self.lines, "report-lines")
        executive = lines.filter("section = 1").agg(F.min("text").alias("t")).scalar()
        return self.window.select(
            F.lit(self.run_id).alias("id"),
            F.lit(title).alias("title"),
            created_at.alias("created_at"),
            F.lit(dataset).alias("dataset_name"),
            (F.col("baseline_count") + F.col("anomaly_count")).alias("row_count"),
            F.col("metric").alias("metric_col"),
            F.lit(date_col).cast("string").alias("date_col"),
            F.col("relative_pct_change").alias("pct_change"),
            "direction", "detection_method", "baseline_mean", "anomaly_mean", "absolute_delta",
            "flagged_points", label("baseline_label"), label("anomaly_label"),
            listed(self.hypotheses, [F.col("rank").alias("_o")]).alias("hypotheses"),
            executive.alias("executive_summary"),
            listed(self.scenarios, [F.col("scenario_rank").alias("_o")]).alias("scenarios"),
            listed(lines, [F.struct("section", "line_no").alias("_o")]).alias("report"),
        )

    def details(self) -> dict[str, DataFrame]:
        """The tables that a later session needs to go on with this run, written and read as tables."""
        return {name: getattr(self, name) for name in DETAILS}

    def save(self, store: RunStore, title: str, dataset: str, saved_at: Column, date_col: str | None = None) -> None:
        row = self.run_row(title, dataset, saved_at.cast("string"), date_col)
        store.save(row, self.details(), saved_at)


def rebuild(store: RunStore, run_id: str) -> Investigation | None:
    """The stored run as an investigation: report, graph, curve and audit follow from its tables."""
    commit = store.commit_of(run_id)
    if commit is None:
        return None
    return Investigation(run_id, None, **{name: store.table(commit, name) for name in DETAILS})


def investigate(
    tagged: DataFrame,
    metric: str,
    dimensions: list[str],
    covariates: list[str],
    run_id: str = "run",
    window: DataFrame | None = None,
    top_segments: int = hyp.TOP_SEGMENTS,
    top_joint: int = hyp.TOP_JOINT,
    max_scenarios: int = MAX_SCENARIOS,
) -> Investigation:
    """Run all hypothesis families over a table with a ``period`` column.

    The fact table is read once for all dimensions, their crossing and the totals,
    and for the covariates once for moments, once for split points and once for
    ranks; the rank test of a hypothesis reads it again only if a cohort is skewed.
    ``top_segments`` segments per dimension and ``top_joint`` crossed cohorts are tested.
    """
    dimensions = [d for d in dimensions if d != metric]
    covariates = [c for c in covariates if c != metric]
    needed = tagged.select("period", *(named(c) for c in dict.fromkeys([metric, *dimensions, *covariates])))
    facts = needed

    def drift() -> list[DataFrame]:
        if not covariates:
            return []
        tested = hyp.covariate_hypotheses(facts, covariates, run_id, metric)
        return [materialize(tested, "covariate-hypotheses")]

    # Covariates and segments share no input but the facts, so their jobs run side by
    # side and fill each other's idle tasks.
    with ThreadPoolExecutor(max_workers=2) as pool:
        drift_jobs = pool.submit(inheritable_thread_target(tagged.sparkSession)(drift))
        long = dec.long_segments(facts, metric, dimensions, joint=True, whole=True)
        segments = materialize(dec.segment_moments(long), "segments")
        totals = dec.totals_row(segments)
        plain = segments.filter(F.col("dimension").isin(dimensions))
        contributions = materialize(dec.contributions(plain, totals), "contributions")
        families = [
            hyp.segment_hypotheses(contributions, long, dimensions, run_id, metric, top_segments),
            hyp.mix_hypotheses(plain, dimensions, run_id, metric),
        ]
        if len(dimensions) >= 2:
            families.append(hyp.joint_hypotheses(segments, long, dimensions, run_id, metric, top_joint))
        if window is None:
            window = window_from_totals(totals, metric, "user_specified")
        window = materialize(window, "window")
        scenarios = materialize(top_scenarios(contributions, max_scenarios), "scenarios")
        families.extend(drift_jobs.result())
    hypotheses = materialize(hyp.rank_hypotheses(families), "hypotheses")
    return Investigation(
        run_id=run_id,
        tagged=tagged,
        window=window,
        segments=plain,
        contributions=contributions,
        hypotheses=hypotheses,
        scenarios=scenarios,
    )
