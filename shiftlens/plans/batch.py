"""Many runs over one table at once: several metrics, several windows.

Every row of the facts is laid out once per (run, dimension) and all tables carry the
run, so segments, tests, covariates, ranks, scenarios and reports of all runs come from
the same jobs; their number does not depend on the number of runs. Totals of the runs
(one row each) are joined by broadcast instead of read as scalars.

NULL metric values count in volumes and not in means. Rows for which the window of a
run is NULL are in neither of its cohorts. A run without rows in a cohort has a window
but no contributions, hypotheses or scenarios; on an empty table no run has rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.numeric import named, number
from shiftlens.operators import decomposition as dec
from shiftlens.operators import hypotheses as hyp
from shiftlens.operators import report
from shiftlens.operators import statistics as st
from shiftlens.operators.cohorts import ANOMALY, BASELINE, PERIOD, window_from_totals
from shiftlens.operators.hypotheses import RUN_KEYS
from shiftlens.operators.scenarios import MAX_SCENARIOS, top_scenarios
from shiftlens.plans.investigation import DETAILS, Investigation
from shiftlens.session import materialize

LABEL = "_run"


@dataclass(frozen=True)
class Run:
    """One metric and the condition that is TRUE for its anomaly and FALSE for its baseline."""

    run_id: str
    metric: str
    is_anomaly: Column
    method: str = "user_specified"


@dataclass
class Batch:
    """Result tables of all runs, written, each with ``run_id`` and ``metric``."""

    runs: list[Run]
    window: DataFrame
    segments: DataFrame
    contributions: DataFrame
    hypotheses: DataFrame
    scenarios: DataFrame

    @property
    def summary(self) -> DataFrame:
        return report.report_summary(self.window, self.hypotheses, F.col("run_id"), RUN_KEYS)

    @property
    def lines(self) -> DataFrame:
        return report.report_lines(
            self.summary,
            report.report_contributions(dec.top_overall(self.contributions, report.CONTRIBUTION_ROWS, RUN_KEYS), RUN_KEYS),
            report.report_matrix(self.hypotheses, RUN_KEYS),
            report.report_scenarios(self.scenarios, RUN_KEYS),
            F.col("run_id"),
        )

    def run(self, run_id: str) -> Investigation:
        """One run of the batch, as if it had been investigated alone."""
        own = {name: getattr(self, name).filter(F.col("run_id") == run_id) for name in DETAILS}
        extra = {"window": ["run_id"], "hypotheses": []}
        return Investigation(run_id, None, **{name: rows.drop(*extra.get(name, RUN_KEYS)) for name, rows in own.items()})


def _checked(runs: list[Run], dimensions: list[str]) -> None:
    if not runs or len({r.run_id for r in runs}) < len(runs):
        raise ValueError("give at least one run, each with an id of its own")
    if clash := {r.metric for r in runs} & set(dimensions):
        raise ValueError(f"metrics cannot be dimensions as well: {sorted(clash)}")


def _period(run: Run) -> Column:
    return F.when(run.is_anomaly, ANOMALY).when(~run.is_anomaly, BASELINE)


def _by_run(rows: DataFrame, names: dict[str, tuple[str, ...]], columns: tuple[str, ...], key: str) -> DataFrame:
    """Rows with ``columns`` of the run, or run and covariate, whose short label stands in ``key``."""
    listed = [(label, *values) for label, values in names.items()]
    table = rows.sparkSession.createDataFrame(listed, f"{key} string, " + ", ".join(f"{c} string" for c in columns))
    return rows.join(F.broadcast(table), key).drop(key)


def long_runs(facts: DataFrame, runs: list[Run], dimensions: list[str]) -> DataFrame:
    """(label, period, x, dimension, segment_value): the layout of ``long_segments`` for all runs, see ``_named_runs``.

    The crossing of the first two dimensions and the whole of each run are dimensions too.
    """
    wide = {f"_d{i}": named(d).cast("string") for i, d in enumerate(dimensions)}
    labels = {f"_d{i}": d for i, d in enumerate(dimensions)}
    if len(dimensions) >= 2:
        wide["_joint"], labels["_joint"] = dec.joint_column(*dimensions[:2]), dec.JOINT.join(dimensions[:2])
    wide["_whole"], labels["_whole"] = F.lit(dec.WHOLE), dec.WHOLE
    entries = F.array(*(
        F.struct(F.lit(str(i)).alias(LABEL), _period(r).alias(PERIOD), number(r.metric).alias("x")) for i, r in enumerate(runs)
    ))
    per_run = facts.select(*(c.alias(k) for k, c in wide.items()), F.inline(entries)).filter(F.col(PERIOD).isNotNull())
    segments = F.array(*(F.struct(F.lit(labels[k]).alias("dimension"), F.col(k).alias("segment_value")) for k in wide))
    return per_run.select(LABEL, PERIOD, "x", F.inline(segments))


def _named_runs(rows: DataFrame, runs: list[Run]) -> DataFrame:
    """Rows with ``run_id`` and ``metric`` instead of the label of their run."""
    return _by_run(rows, {str(i): (r.run_id, r.metric) for i, r in enumerate(runs)}, RUN_KEYS, LABEL)


def _pairs(runs: list[Run], covariates: list[str]) -> dict[str, tuple[int, int]]:
    """Label of each pair of a run and a covariate that is not its metric."""
    return {f"{i}.{j}": (i, j) for i, r in enumerate(runs) for j, c in enumerate(covariates) if c != r.metric}


def _windows(facts: DataFrame, runs: list[Run]) -> list[int]:
    """For each run the first one whose condition means the same."""
    plans = [facts.select(_period(r).alias(PERIOD)) for r in runs]
    return [next(k for k in range(i + 1) if k == i or plans[k].sameSemantics(plan)) for i, plan in enumerate(plans)]


def _labelled(rows: DataFrame, key_of: dict[str, str]) -> DataFrame:
    """Rows per key in ``covariate``, once for each label that has this key."""
    table = rows.sparkSession.createDataFrame([(key, label) for label, key in key_of.items()], "covariate string, _label string")
    return rows.join(F.broadcast(table), "covariate").drop("covariate").withColumnRenamed("_label", "covariate")


def _covariates(facts: DataFrame, runs: list[Run], covariates: list[str]) -> DataFrame:
    """Correlations are computed once per pair of columns, shifts once per window and covariate, for all runs."""
    columns = list(dict.fromkeys([*(r.metric for r in runs), *covariates]))
    first, pairs, shifts, pair_of, shift_of = _windows(facts, runs), {}, {}, {}, {}
    for label, (i, j) in _pairs(runs, covariates).items():
        x, y = sorted((columns.index(covariates[j]), columns.index(runs[i].metric)))
        pair_of[label], shift_of[label] = f"{x}.{y}", f"{first[i]}.{j}"
        pairs[pair_of[label]] = (columns[x], columns[y])
        shifts[shift_of[label]] = (f"p{first[i]}", covariates[j])
    placed = hyp.placed_columns(facts, {f"p{i}": _period(runs[i]) for i in sorted(set(first))}, columns)
    long = hyp.shifted_values(placed, shifts, columns)
    shift = hyp.covariate_shift(long, materialize(st.moments(long, ["covariate"]), "moments"))
    ranked = st.spearman_columns(placed, pairs, hyp.places(columns))
    judged = hyp.judged_covariates(
        _labelled(hyp.paired_sums(placed, pairs, columns), pair_of), _labelled(ranked, pair_of), _labelled(shift, shift_of)
    )
    names = {label: (runs[i].run_id, runs[i].metric, covariates[j]) for label, (i, j) in _pairs(runs, covariates).items()}
    tested = _by_run(judged.withColumnRenamed("covariate", "_pair"), names, (*RUN_KEYS, "covariate"), "_pair")
    return hyp.covariate_family(tested, covariates, F.col("run_id"), F.col("metric"))


def investigate_runs(
    facts: DataFrame,
    runs: list[Run],
    dimensions: list[str],
    covariates: list[str],
    top_segments: int = hyp.TOP_SEGMENTS,
    top_joint: int = hyp.TOP_JOINT,
    max_scenarios: int = MAX_SCENARIOS,
) -> Batch:
    """All hypothesis families, scenarios and reports of all ``runs`` over the same dimensions and covariates.

    Metrics may be covariates of other runs, but not dimensions. Results equal those of
    ``investigate`` run by run.
    """
    _checked(runs, dimensions)
    run_id, metric, keys = F.col("run_id"), F.col("metric"), RUN_KEYS
    labelled = long_runs(facts, runs, dimensions)
    segments = materialize(_named_runs(dec.segment_moments(labelled, (LABEL,)), runs), "segments")
    long = _named_runs(labelled, runs)
    totals = materialize(dec.totals_row(segments, keys), "totals")
    plain = segments.filter(F.col("dimension").isin(dimensions))
    contributions = materialize(dec.contributions(plain, totals, keys), "contributions")
    families = [
        hyp.segment_hypotheses(contributions, long, dimensions, run_id, metric, top_segments, keys),
        hyp.mix_hypotheses(plain, dimensions, run_id, metric, keys),
    ]
    if _pairs(runs, covariates):
        families.append(materialize(_covariates(facts, runs, covariates), "covariate-hypotheses"))
    if len(dimensions) >= 2:
        families.append(hyp.joint_hypotheses(segments, long, dimensions, run_id, metric, top_joint, keys))
    methods = F.create_map(*(F.lit(text) for r in runs for text in (r.run_id, r.method)))
    return Batch(
        runs=runs,
        window=materialize(window_from_totals(totals, metric, methods[run_id], keys=("run_id",)), "window"),
        segments=plain,
        contributions=contributions,
        hypotheses=materialize(hyp.rank_hypotheses(families), "hypotheses"),
        scenarios=materialize(top_scenarios(contributions, max_scenarios, keys), "scenarios"),
    )
