"""Registered queries: (spark, sf_dir) -> DataFrame, whole tables every time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import facts
from shiftlens.functions.numeric import rounded
from shiftlens.operators import charts, cleaning, detection, evidence, isolation, profiling, report, scenarios, sketches
from shiftlens.operators import decomposition as dec
from shiftlens.operators import hypotheses as hyp
from shiftlens.operators import statistics as st
from shiftlens.operators.cohorts import window_summary
from shiftlens.plans.batch import Run, investigate_runs
from shiftlens.plans.investigation import Investigation, detect_window, investigate, rebuild
from shiftlens.session import materialize, new_table_path
from shiftlens.sources import files, history

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SEGMENT = hyp.SEGMENT
HISTORY_KINDS = [(c, "long" if c == "row_count" else "double" if c == "pct_change" else "string") for c in history.META[1:]]


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def out(df: DataFrame, *columns: str, digits: int = 4, **special: int) -> DataFrame:
    """Output edge: doubles rounded, integers widened, dates and times as text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    shaped = []
    for name in columns or df.columns:
        column, kind = F.col(name), kinds[name]
        if isinstance(kind, T.DoubleType):
            column = rounded(column, special.get(name, digits))
        elif isinstance(kind, (T.IntegerType, T.LongType)):
            column = column.cast("long")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        shaped.append(column.alias(name))
    return df.select(*shaped)


# --- sources and history -------------------------------------------------------

@query
def scan_csv(spark, sf_dir):
    orders = facts.table(spark, sf_dir, "orders")
    path = new_table_path(spark, "orders-csv")
    files.write_csv(orders, path)
    back = files.read_csv(spark, path, orders.schema)
    return out(back, digits=2)


@query
def preview_rows(spark, sf_dir):
    return out(files.preview(facts.table(spark, sf_dir, "orders"), ["o_orderkey"]), digits=2)


def _brand_runs(spark, sf_dir) -> DataFrame:
    """One stored run per part brand: mean price of large parts against small ones."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    small, large = F.when(size <= 25, price), F.when(size > 25, price)
    change = F.avg(large) - F.avg(small)
    return facts.table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("row_count"),
        (change / (F.abs(F.avg(small)) + 1e-9) * 100.0).alias("pct_change"),
        F.min("p_size").alias("first_size"),
    ).select(
        F.col("p_brand").alias("id"),
        F.concat(F.lit("Investigation of "), "p_brand").alias("title"),
        F.concat(F.lit("2024-01-"), F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 2, "0")).alias("created_at"),
        F.lit("part").alias("dataset_name"),
        "row_count",
        F.lit("p_retailprice").alias("metric_col"),
        "pct_change",
        F.when(F.col("pct_change") < 0, "drop").otherwise("spike").alias("direction"),
        F.lit("user_specified").alias("detection_method"),
    )


def _stamp(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _history(spark, sf_dir) -> DataFrame:
    """Every brand saved once, brands with an even day saved again with a new title."""
    runs = _brand_runs(spark, sf_dir)
    again = runs.filter(F.substring("created_at", 9, 2).cast("int") % 2 == 0).withColumn(
        "title", F.concat("title", F.lit(" (revised)"))
    )
    first = history.versioned(runs, _stamp("2024-03-01 00:00:00"))
    second = history.versioned(again, _stamp("2024-03-02 00:00:00"))
    return first.unionByName(second)


def _deletions(spark, sf_dir) -> DataFrame:
    day = F.substring("created_at", 9, 2).cast("int")
    return _brand_runs(spark, sf_dir).filter(day % 5 == 0).select("id")


@query
def history_upsert(spark, sf_dir):
    return out(history.current(_history(spark, sf_dir)).drop("saved_at", "deleted"))


@query
def history_list(spark, sf_dir):
    return out(history.list_runs(_history(spark, sf_dir)))


@query
def history_load(spark, sf_dir):
    return out(history.load_run(_history(spark, sf_dir), "Brand#4").drop("saved_at", "deleted"))


@query
def history_delete(spark, sf_dir):
    saved = _history(spark, sf_dir)
    ids = _deletions(spark, sf_dir)
    removed = history.tombstones(ids, saved, _stamp("2024-03-03 00:00:00"))
    left = history.current(saved.unionByName(removed))
    gone = history.count_deleted(saved, ids)
    return out(left.select("id", "title").withColumn("n_deleted", gone.scalar()))


# --- cleaning --------------------------------------------------------------------

@query
def clean_trim(spark, sf_dir):
    talk = facts.table(spark, sf_dir, "conversations")
    padded = talk.withColumn(
        "text",
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" \t\n"), "text", F.lit("  \r\n"))).otherwise(F.col("text")),
    )
    return out(cleaning.trim_strings(padded))


@query
def clean_dates(spark, sf_dir):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    odd = F.when(key % 13 == 0, "not a date").when(key % 29 != 0, day)
    rows = facts.table(spark, sf_dir, "orders").select("o_orderkey", odd.alias("order_day"))
    cleaned = cleaning.clean(rows, "order_day")
    return cleaned.select("o_orderkey", F.date_format("order_day", "yyyy-MM-dd").alias("order_day"))


def _dated_orders(spark, sf_dir) -> DataFrame:
    """The order date written in several ways; one row in a hundred holds no date."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    written = [F.date_format(day, form) for form in ("MM/dd/yyyy", "d MMM yyyy", "yyyy-MM-dd", "dd.MM.yyyy HH:mm", "MMMM d, yyyy")]
    rows = {
        "us_date": written[0], "eu_date": written[3], "long_date": written[4],
        "mixed_date": F.when(key % 3 == 0, written[0]).when(key % 3 == 1, written[1]).otherwise(written[2]),
    }
    bad = F.when(key % 100 == 7, F.lit("unknown"))
    return facts.table(spark, sf_dir, "orders").select("o_orderkey", *(F.coalesce(bad, v).alias(k) for k, v in rows.items()))


@query
def clean_date_formats(spark, sf_dir):
    rows = _dated_orders(spark, sf_dir)
    for name in ("us_date", "eu_date", "long_date", "mixed_date"):
        rows = cleaning.clean(rows, name).withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm"))
    return out(rows)


@query
def date_election(spark, sf_dir):
    rows = _dated_orders(spark, sf_dir)
    counts = profiling.value_counts(rows)
    kinds = profiling.infer_types(rows, counts).filter(F.col("column") != "o_orderkey")
    counted = F.col("parsed_count").cast("long").alias("parsed_count")
    return out(kinds.select("column", "inferred_type", "plain", "month_first", "day_first", "is_day_first", counted, "parsed_share"))


@query
def coerce_numeric(spark, sf_dir):
    odd = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    rows = facts.table(spark, sf_dir, "events").select("event_id", odd.alias("k"))
    return out(cleaning.coerce_number(rows, "k"))


@query
def metric_backfill(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = facts.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.when(key % 17 > 2, F.col("o_totalprice")).alias("amount")
    )
    filled = cleaning.backfill_metric(rows, ["o_orderdate", "o_orderkey"], "amount")
    return out(filled.select("o_orderkey", "amount"), digits=2)


# --- profiling ---------------------------------------------------------------------

@query
def dataset_shape(spark, sf_dir):
    return profiling.dataset_shape(facts.mixed_fact(spark, sf_dir))


@query
def duplicate_rows(spark, sf_dir):
    rows = facts.table(spark, sf_dir, "lineitem")
    again = rows.filter((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") <= 2))
    return out(profiling.duplicate_rows(rows.unionByName(again)))


@query
def column_profile(spark, sf_dir):
    fact = facts.mixed_fact(spark, sf_dir)
    table = profiling.column_counts(fact, profiling.value_counts(fact))
    return out(
        table, "column", "total_count", "missing_count", "missing_pct", "unique_count", "is_constant"
    )


def _types(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    fact = facts.mixed_fact(spark, sf_dir)
    counts = materialize(profiling.value_counts(fact), "value-counts")
    return fact, counts, profiling.infer_types(fact, counts)


@query
def column_types(spark, sf_dir):
    return out(_types(spark, sf_dir)[2], "column", "inferred_type", "is_id_candidate")


@query
def numeric_stats(spark, sf_dir):
    fact, _, types = _types(spark, sf_dir)
    return out(profiling.numeric_stats(profiling.measured(fact, types)))


@query
def iqr_outliers(spark, sf_dir):
    fact, _, types = _types(spark, sf_dir)
    return out(profiling.iqr_outliers(profiling.measured(fact, types)))


@query
def top_categories(spark, sf_dir):
    _, counts, types = _types(spark, sf_dir)
    kept = types.filter(F.col("inferred_type").isin("categorical", "boolean")).select("column")
    return out(profiling.top_values(counts).join(F.broadcast(kept), "column"))


@query
def frequent_values(spark, sf_dir):
    rows = facts.table(spark, sf_dir, "lineitem")
    columns = ["l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber", "l_partkey", "l_orderkey"]
    rows = rows.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return out(sketches.frequent_values(rows, columns, k=7))


@query
def merged_distincts(spark, sf_dir):
    """States of two halves of the data, written, read back and added up, held against exact counts."""
    fact = facts.mixed_fact(spark, sf_dir)
    early = F.col("o_orderkey") % 3 == 0
    halves = [materialize(sketches.column_state(fact.filter(side)), "column-state") for side in (early, ~early)]
    found = sketches.distinct_estimates(sketches.merge_states(*halves))
    exact = profiling.column_counts(fact, profiling.value_counts(fact)).select("column", "unique_count")
    error = F.abs(F.col("unique_estimate") - F.col("unique_count"))
    rows = found.join(F.broadcast(exact), "column")
    within = error <= F.col("error_share") * F.col("unique_count")
    return out(rows.withColumn("within_error", within), "column", "total_count", "missing_count", "unique_count", "within_error")


@query
def candidate_columns(spark, sf_dir):
    return out(profiling.candidates(_types(spark, sf_dir)[2]))


@query
def schema_health(spark, sf_dir):
    fact, counts, types = _types(spark, sf_dir)
    types = materialize(types, "column-types")
    numbers = profiling.measured(fact, types)
    quarters = materialize(profiling.quartiles(numbers), "quartiles")
    return profiling.schema_health(
        types,
        profiling.numeric_stats(numbers, quarters),
        profiling.iqr_outliers(numbers, quarters),
        profiling.top_values(counts),
    )


# --- detection -------------------------------------------------------------------------

# Means of a few cents values often end in a 5 at the fifth digit; round further out.
FINE = {"metric_mean": 7, "expected": 7}

def _daily(spark, sf_dir) -> DataFrame:
    return detection.daily_points(facts.orders_plain(spark, sf_dir), "ts", "amount")


@query
def daily_metric(spark, sf_dir):
    return out(detection.daily_metric(facts.orders_plain(spark, sf_dir), "ts", "amount"), metric_mean=7)


@query
def rolling_baseline(spark, sf_dir):
    return out(_daily(spark, sf_dir), "day", "metric_mean", "expected", "spread", **FINE)


POINT_COLUMNS = ["metric_mean", "expected", "deviation_z", "is_anomaly", "anomaly_score", "severity"]


@query
def rolling_z_points(spark, sf_dir):
    return out(_daily(spark, sf_dir), "day", *POINT_COLUMNS, **FINE)


@query
def flagged_points(spark, sf_dir):
    return out(detection.flagged(_daily(spark, sf_dir)), "day", *POINT_COLUMNS, **FINE)


@query
def row_rolling_points(spark, sf_dir):
    points = detection.row_points(facts.events_plain(spark, sf_dir), ["ts", "row_id"], "value")
    return out(points, "row_id", "value", "expected", "spread", "is_anomaly", "severity")


def _step_points(spark, sf_dir) -> DataFrame:
    return detection.daily_points(facts.step_fact(spark, sf_dir), "ts", "level")


@query
def changepoint(spark, sf_dir):
    step = detection.changepoint(_step_points(spark, sf_dir)).withColumn("series", F.lit("step"))
    noise = detection.changepoint(_daily(spark, sf_dir)).withColumn("series", F.lit("orders"))
    return out(step.unionByName(noise))


@query
def series_window(spark, sf_dir):
    step = detection.series_window(_step_points(spark, sf_dir), "day", "level")
    events = detection.daily_points(facts.events_plain(spark, sf_dir), "ts", "value")
    return out(step.unionByName(detection.series_window(events, "day", "value")))


@query
def temporal_changepoint(spark, sf_dir):
    step, points = facts.step_fact(spark, sf_dir), _step_points(spark, sf_dir)
    first = detection.temporal_window(step, "ts", "level", points).withColumn("mode", F.lit("first_flag"))
    severe = detection.temporal_window(step, "ts", "level", points, "most_severe")
    orders = facts.orders_plain(spark, sf_dir)
    noise = detection.temporal_window(orders, "ts", "amount", _daily(spark, sf_dir))
    return out(
        first.unionByName(severe.withColumn("mode", F.lit("most_severe"))).unionByName(
            noise.withColumn("mode", F.lit("orders"))
        )
    )


def _window(fact: DataFrame, metric: str) -> DataFrame:
    return window_summary(fact, metric, "user_specified")


@query
def window_summary_query(spark, sf_dir):
    rows = _window(facts.orders_fact(spark, sf_dir), "amount")
    return out(rows.unionByName(_window(facts.events_fact(spark, sf_dir), "value")))


REGISTRY["window_summary"] = REGISTRY.pop("window_summary_query")


def _measured_events(spark, sf_dir) -> DataFrame:
    """Events with two numeric features for the forest."""
    k = F.get_json_object("props", "$.k").cast("double")
    return facts.events_plain(spark, sf_dir).join(
        facts.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), k.alias("k")), "row_id"
    )


def _forest(spark, sf_dir) -> DataFrame:
    return isolation.forest_points(_measured_events(spark, sf_dir), "value", ["row_id"], ["k"])


@query
def iforest_points(spark, sf_dir):
    return out(
        _forest(spark, sf_dir), "row_id", "value", "expected", "deviation_z", "is_anomaly", "anomaly_score", "severity"
    )


@query
def iforest_window(spark, sf_dir):
    return out(isolation.forest_window(_forest(spark, sf_dir), "value"))


@query
def fallback_split(spark, sf_dir):
    rows = facts.events_plain(spark, sf_dir)
    return out(detection.fallback_window(rows, ["ts", "row_id"], "value"))


@query
def auto_window(spark, sf_dir):
    dated = detect_window(facts.step_fact(spark, sf_dir), "level", ["row_id"], "ts").window
    undated = detect_window(_measured_events(spark, sf_dir).drop("ts"), "value", ["row_id"]).window
    return out(dated.unionByName(undated))


# --- tests -------------------------------------------------------------------------------

def _shipment_long(spark, sf_dir) -> DataFrame:
    return dec.long_segments(facts.shipments_fact(spark, sf_dir), "revenue", facts.SHIPMENTS_DIMS, joint=True)


def _event_long(spark, sf_dir) -> DataFrame:
    return dec.long_segments(facts.events_fact(spark, sf_dir), "value", facts.EVENTS_DIMS)


def _segmented(long: DataFrame) -> DataFrame:
    return long.filter(F.col("segment_value").isNotNull())


def _moments(long: DataFrame) -> DataFrame:
    return st.moments(_segmented(long), SEGMENT)


@query
def two_sample_summary(spark, sf_dir):
    return out(_moments(_event_long(spark, sf_dir)))


@query
def cohens_d(spark, sf_dir):
    tested = st.effect_size(_moments(_shipment_long(spark, sf_dir)))
    return out(tested, *SEGMENT, "cohens_d", digits=6)


@query
def welch_t(spark, sf_dir):
    tested = st.welch(_moments(_shipment_long(spark, sf_dir)))
    return out(tested, *SEGMENT, "welch_t", "welch_df", "welch_p", welch_t=5, welch_df=3, welch_p=7)


@query
def mann_whitney(spark, sf_dir):
    ranks = st.rank_sum(_segmented(_event_long(spark, sf_dir)), SEGMENT)
    return out(ranks, *SEGMENT, "u_stat", "u_z", "u_p", "distinct_values", u_stat=1, u_z=6, u_p=7)


def _tested(long: DataFrame) -> DataFrame:
    long = _segmented(long)
    return st.two_sample(materialize(st.moments(long, SEGMENT), "moments"), long, SEGMENT)


TEST_COLUMNS = [*SEGMENT, "test_name", "statistic", "p_value", "effect", "n_base", "n_anom", "df"]


@query
def test_selection(spark, sf_dir):
    events = _tested(_event_long(spark, sf_dir)).withColumn("fact", F.lit("events"))
    quality = facts.quality_fact(spark, sf_dir)
    binary = _tested(dec.long_segments(quality, "toxic", ["lang", "source"])).withColumn("fact", F.lit("quality"))
    return out(events.unionByName(binary), "fact", *TEST_COLUMNS, p_value=7)


@query
def mean_diff_ci(spark, sf_dir):
    tested = st.mean_difference_ci(_moments(_shipment_long(spark, sf_dir)))
    return out(tested, *SEGMENT, "mean_diff", "ci_low", "ci_high")


@query
def evidence_text(spark, sf_dir):
    subject = F.concat_ws("=", *SEGMENT)
    worded = st.with_words(_tested(_shipment_long(spark, sf_dir)), subject)
    return out(worded, *SEGMENT, "test_name", "effect_word", "significance", "shift", "interpretation")


def _event_segments(spark, sf_dir) -> DataFrame:
    return dec.segment_moments(_event_long(spark, sf_dir))


def _shipment_segments(spark, sf_dir) -> DataFrame:
    return dec.segment_moments(_shipment_long(spark, sf_dir))


@query
def contingency(spark, sf_dir):
    return out(_event_segments(spark, sf_dir), *SEGMENT, "volume_base", "volume_anom")


@query
def chi_square(spark, sf_dir):
    tested = st.chi_square(_shipment_segments(spark, sf_dir))
    return out(tested, "dimension", "categories", "df", "chi2", "p_value", chi2=6, p_value=7)


@query
def cramers_v(spark, sf_dir):
    quality = facts.quality_fact(spark, sf_dir)
    tested = st.chi_square(dec.segment_moments(dec.long_segments(quality, "quality", ["lang", "source"])))
    return out(tested, "dimension", "total_base", "total_anom", "chi2", "cramers_v", "association", digits=6)


def _covariates(spark, sf_dir) -> DataFrame:
    return hyp.long_covariates(facts.shipments_fact(spark, sf_dir), "revenue", facts.SHIPMENTS_COVARIATES)


@query
def pearson(spark, sf_dir):
    table = _covariates(spark, sf_dir).groupBy("covariate").agg(*st.pair_columns())
    return out(st.pearson(table), "covariate", "n_pairs", "r", "r_p", r=6, r_p=7)


@query
def spearman(spark, sf_dir):
    fact = facts.shipments_fact(spark, sf_dir)
    names = ["revenue", *facts.SHIPMENTS_COVARIATES]
    pairs = {c: (c, "revenue") for c in facts.SHIPMENTS_COVARIATES}
    ranked = st.spearman_columns(hyp.placed_columns(fact, {}, names), pairs, hyp.places(names))
    return out(ranked, rho=6, rho_p=7)


@query
def covariate_shift(spark, sf_dir):
    fact, names = facts.shipments_fact(spark, sf_dir), facts.SHIPMENTS_COVARIATES
    placed = hyp.placed_columns(fact, {"period": F.col("period")}, names)
    long = hyp.shifted_values(placed, {c: ("period", c) for c in names}, names)
    tested = hyp.covariate_shift(long, materialize(st.moments(long, ["covariate"]), "moments"))
    return out(tested, "covariate", "test_name", "statistic", "p_value", "effect", "df", p_value=7)


@query
def hypothesis_status(spark, sf_dir):
    judged = st.verdict(_tested(_shipment_long(spark, sf_dir)), F.lit(-1.0))
    return out(judged, *SEGMENT, "status", "score")


# --- decomposition -------------------------------------------------------------------------

def _order_contribs(spark, sf_dir) -> DataFrame:
    return dec.decompose(facts.orders_fact(spark, sf_dir), "amount", ["status", "priority"], "ts")


def _event_contribs(spark, sf_dir) -> DataFrame:
    return dec.decompose(facts.events_fact(spark, sf_dir), "value", facts.EVENTS_DIMS, "ts")


def _shipment_contribs(spark, sf_dir) -> DataFrame:
    return dec.decompose(facts.shipments_fact(spark, sf_dir), "revenue", facts.SHIPMENTS_DIMS, "ts")


RATE_COLUMNS = ["volume_base", "volume_anom", "share_base", "share_anom", "rate_base", "rate_anom"]


@query
def segment_rates(spark, sf_dir):
    return out(_event_contribs(spark, sf_dir), *SEGMENT, *RATE_COLUMNS, digits=6)


@query
def rate_mix(spark, sf_dir):
    return out(_event_contribs(spark, sf_dir), *SEGMENT, "rate_effect", "mix_effect", digits=6)


@query
def segment_contributions(spark, sf_dir):
    fact = facts.orders_fact(spark, sf_dir)
    contribs = dec.decompose(fact, "amount", ["status"], "ts")
    return out(contribs, *SEGMENT, "rate_change", "contribution", "pct_of_total", "is_primary")


@query
def decompose_all(spark, sf_dir):
    return out(
        _order_contribs(spark, sf_dir), *SEGMENT, *RATE_COLUMNS,
        "rate_effect", "mix_effect", "contribution", "pct_of_total", "is_primary",
    )


@query
def top_contributors(spark, sf_dir):
    top = dec.top_per_dimension(_event_contribs(spark, sf_dir), 3)
    return out(top, *SEGMENT, "impact_rank", "contribution")


@query
def contribution_bars(spark, sf_dir):
    contribs = _order_contribs(spark, sf_dir)
    direction = F.when(F.col("total_delta") < 0, "drop").otherwise("spike")
    return out(dec.contribution_bars(contribs, direction))


# --- hypotheses ------------------------------------------------------------------------------

HYP_COLUMNS = ["hypothesis_id", "dimension", "dimension_value", "title", "status", "score"]


@query
def hyp_segment(spark, sf_dir):
    contribs = materialize(_event_contribs(spark, sf_dir), "contributions")
    rows = hyp.segment_hypotheses(contribs, _event_long(spark, sf_dir), facts.EVENTS_DIMS, "events", "value")
    first = F.get("evidence", F.lit(0))
    rows = rows.withColumn("test_name", first["test_name"]).withColumn("p_value", first["p_value"])
    return out(rows, *HYP_COLUMNS, "description", "test_name", "p_value", p_value=7)


@query
def hyp_mix(spark, sf_dir):
    rows = hyp.mix_hypotheses(_event_segments(spark, sf_dir), facts.EVENTS_DIMS, "events", "value")
    first = F.get("evidence", F.lit(0))
    rows = rows.withColumn("chi2", first["statistic"]).withColumn("p_value", first["p_value"])
    return out(rows, *HYP_COLUMNS, "chi2", "p_value", p_value=7)


@query
def hyp_covariate(spark, sf_dir):
    fact = facts.shipments_fact(spark, sf_dir)
    rows = hyp.covariate_hypotheses(fact, facts.SHIPMENTS_COVARIATES, "shipments", "revenue")
    return out(rows.withColumn("n_evidence", F.size("evidence")), *HYP_COLUMNS, "n_evidence")


@query
def hyp_interaction(spark, sf_dir):
    long = _shipment_long(spark, sf_dir)
    segments = materialize(dec.segment_moments(long), "segments")
    rows = hyp.joint_hypotheses(segments, long, facts.SHIPMENTS_DIMS, "shipments", "revenue")
    return out(rows, *HYP_COLUMNS)


def _investigation(spark, sf_dir) -> Investigation:
    fact = facts.shipments_fact(spark, sf_dir)
    return investigate(fact, "revenue", facts.SHIPMENTS_DIMS, facts.SHIPMENTS_COVARIATES, "shipments")


@query
def hypotheses_ranked(spark, sf_dir):
    rows = _investigation(spark, sf_dir).hypotheses
    return out(rows, "rank", "family", *HYP_COLUMNS)


@query
def hyp_by_status(spark, sf_dir):
    rows = hyp.by_status(_investigation(spark, sf_dir).hypotheses, "supported")
    return out(rows, "rank", "family", *HYP_COLUMNS)


# --- scenarios ---------------------------------------------------------------------------------

@query
def scenario_candidates(spark, sf_dir):
    contribs = materialize(_event_contribs(spark, sf_dir), "contributions")
    return out(scenarios.scenario_candidates(contribs), *SEGMENT, "contribution", "rate_change", "is_primary")


SCENARIO_COLUMNS = [
    "observed_metric", "projected_metric", "restoration_delta", "recovery_pct", "signed_recovery_pct",
    "ci_lower", "ci_upper",
]


@query
def counterfactual(spark, sf_dir):
    return out(scenarios.restore(_event_contribs(spark, sf_dir)), *SEGMENT, *SCENARIO_COLUMNS)


@query
def top_scenarios(spark, sf_dir):
    contribs = materialize(_shipment_contribs(spark, sf_dir), "contributions")
    return out(scenarios.top_scenarios(contribs), "scenario_rank", "scenario", *SCENARIO_COLUMNS)


@query
def remediation_curve(spark, sf_dir):
    contribs = materialize(_shipment_contribs(spark, sf_dir), "contributions")
    return out(scenarios.remediation_curve(scenarios.top_scenarios(contribs)))


# --- graph, report, charts -------------------------------------------------------------------------

@query
def graph_nodes(spark, sf_dir):
    nodes = evidence.graph_nodes(_investigation(spark, sf_dir).hypotheses)
    return out(nodes, "run_id", "node_id", "node_type", "size", "color")


@query
def graph_edges(spark, sf_dir):
    return out(evidence.graph_edges(_investigation(spark, sf_dir).hypotheses))


@query
def report_summary(spark, sf_dir):
    return out(_investigation(spark, sf_dir).summary)


@query
def report_contributions(spark, sf_dir):
    contribs = _shipment_contribs(spark, sf_dir)
    return out(report.report_contributions(dec.top_overall(contribs, report.CONTRIBUTION_ROWS)))


@query
def report_matrix(spark, sf_dir):
    return out(report.report_matrix(_investigation(spark, sf_dir).hypotheses))


@query
def report_scenarios(spark, sf_dir):
    contribs = materialize(_shipment_contribs(spark, sf_dir), "contributions")
    return out(report.report_scenarios(scenarios.top_scenarios(contribs)))


@query
def report_lines(spark, sf_dir):
    return out(_investigation(spark, sf_dir).lines)


@query
def report_export(spark, sf_dir):
    """The report as text files, one folder per run, read back."""
    path = new_table_path(spark, "report")
    files.write_text(_investigation(spark, sf_dir).lines, path)
    return out(spark.read.text(path).withColumnRenamed("value", "text"), "run_id", "text")


@query
def report_lines_batch(spark, sf_dir):
    """Reports of three metrics in two windows each, from one set of jobs."""
    runs = [
        Run(f"{metric}@{cutoff}", metric, F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz"))
        for metric in facts.BATCH_METRICS for cutoff in facts.BATCH_CUTOFFS
    ]
    rows = facts.shipments_fact(spark, sf_dir).drop("period")
    return out(investigate_runs(rows, runs, facts.SHIPMENTS_DIMS, facts.SHIPMENTS_COVARIATES).lines)


@query
def history_rebuild(spark, sf_dir):
    """The report of a run that was saved, half saved again with other tables, and rebuilt."""
    store, run = history.RunStore(spark, new_table_path(spark, "run-store")), _investigation(spark, sf_dir)
    run.save(store, "Shipments", "lineitem", _stamp("2024-05-01 00:00:00"))
    store.write_details({name: rows.limit(0) for name, rows in run.details().items()})
    return out(rebuild(store, "shipments").lines)


@query
def history_contributions(spark, sf_dir):
    """Contributions of all listed runs: one saved twice, one deleted, and an unfinished save."""
    store, contribs = history.RunStore(spark, new_table_path(spark, "run-store")), _shipment_contribs(spark, sf_dir)
    contribs = materialize(contribs, "contributions")
    for k, (run_id, rows) in enumerate([("a", contribs.limit(1)), ("a", contribs), ("b", contribs), ("c", contribs)]):
        row = spark.range(1).select(F.lit(run_id).alias("id"), *(F.lit(None).cast(t).alias(c) for c, t in HISTORY_KINDS))
        store.save(row, {"contributions": rows}, _stamp(f"2024-05-0{k + 1} 00:00:00"))
    store.runs.delete(spark.createDataFrame([("b",)], "id string"), _stamp("2024-05-09 00:00:00"))
    store.write_details({"contributions": contribs})
    return out(store.all_details("contributions"), "id", *SEGMENT, "contribution")


@query
def audit_trail(spark, sf_dir):
    return out(_investigation(spark, sf_dir).audit(_stamp("2024-01-01 00:00:00")))


@query
def chart_series(spark, sf_dir):
    window = _window(facts.orders_fact(spark, sf_dir), "amount")
    return out(charts.chart_series(_daily(spark, sf_dir), window), metric_mean=7)


@query
def chart_histogram(spark, sf_dir):
    return out(charts.chart_histogram(facts.events_fact(spark, sf_dir), "value"))


@query
def chart_box(spark, sf_dir):
    fact = facts.events_fact(spark, sf_dir)
    return out(charts.chart_box(fact, "value", F.col("event_type") == "error"))
