"""Profile, clean, detect, investigate, report and store, on planted incidents."""

from __future__ import annotations

import frames
import pytest
from pyspark.sql import functions as F

from shiftlens.operators import profiling
from shiftlens.operators.cleaning import clean
from shiftlens.operators.cohorts import tag
from shiftlens.plans.investigation import detect_window, investigate, rebuild
from shiftlens.sources import files
from shiftlens.sources.history import HistoryTable, RunStore, current


@pytest.fixture(scope="module")
def parcels(spark):
    df = spark.createDataFrame(frames.parcels())
    return df, profiling.profile(df, ["parcel_key"])


def test_parcels_profile(parcels):
    _, found = parcels
    assert found.names("date") == ["date"]
    assert found.names("metric") == ["scan_latency", "item_count", "fee_amount", "on_time"]
    assert found.names("segment") == ["region", "carrier", "shift", "on_time"]
    kinds = {r["column"]: r["inferred_type"] for r in found.types.collect()}
    assert kinds["parcel_key"] == "text_id" and kinds["on_time"] == "boolean"


def test_parcels_investigation(spark, parcels, tmp_path):
    df, found = parcels
    cleaned = clean(df, "date")
    detected = detect_window(cleaned, "on_time", ["parcel_key"], "date")
    assert detected.window.first()["baseline_count"] > 0

    tagged = tag(cleaned, F.col("date") >= F.lit("2023-03-11").cast("timestamp"))
    dimensions = [d for d in found.names("segment") if d != "on_time"]
    covariates = [m for m in found.names("metric") if m != "on_time"]
    run = investigate(tagged, "on_time", dimensions, covariates, "RUN-1")

    hypotheses = run.hypotheses.toPandas()
    assert list(hypotheses.sort_values("rank")["rank"]) == list(range(1, len(hypotheses) + 1))
    supported = hypotheses[hypotheses["status"] == "supported"]
    assert {"Kite × coast", "coast × Kite"} & set(supported["dimension_value"])
    assert "scan_latency" in set(supported["dimension"])
    latency = hypotheses[hypotheses["dimension"] == "scan_latency"].iloc[0]["evidence"]
    assert [e["test_name"].split(" (")[0] for e in latency] == [
        "Pearson Correlation", "Spearman Rank Correlation", "Covariate Shift",
    ]
    assert latency[2]["p_text"] == "< 0.0001"
    leading = run.contributions.filter("dimension = 'carrier'").orderBy(F.desc(F.abs("contribution"))).first()
    assert leading["segment_value"] == "Kite" and leading["is_primary"]
    assert run.nodes.count() > 5 and run.edges.count() > 5
    assert run.scenarios.first()["recovery_pct"] > 0
    assert {r["section"] for r in run.lines.collect()} == {1, 2, 3, 4, 5}
    assert run.curve.count() == 10 * run.scenarios.count()

    history = HistoryTable(spark, f"file:{tmp_path}/history")
    created = F.lit("2024-11-01 12:00:00")
    saved_at = F.lit("2024-11-01 12:00:00").cast("timestamp")
    row = run.run_row("End to end", "shop", created, "date")
    assert history.list().count() == 0 and history.load("RUN-1").count() == 0
    assert history.delete(spark.createDataFrame([("RUN-1",)], "id string"), saved_at) == 0
    history.save(row, saved_at)
    history.save(row.withColumn("title", F.lit("Again")), saved_at + F.expr("interval 1 minute"))
    listed = history.list().collect()
    assert [(r["id"], r["title"]) for r in listed] == [("RUN-1", "Again")]
    loaded = history.load("RUN-1").first()
    assert loaded["metric_col"] == "on_time"
    assert len(loaded["hypotheses"]) == len(hypotheses)
    assert "contributions" not in loaded and loaded["executive_summary"].startswith("on_time moved from")
    assert history.load("missing").count() == 0
    ids = spark.createDataFrame([("RUN-1",), ("missing",)], "id string")
    assert history.delete(ids, saved_at + F.expr("interval 2 minutes")) == 1
    assert history.list().count() == 0
    assert history.delete(ids, saved_at + F.expr("interval 3 minutes")) == 0

    files.write_text(run.lines, f"file:{tmp_path}/report")
    assert spark.read.text(f"file:{tmp_path}/report").count() == run.lines.count()


def test_save_crash_save_and_rebuild(spark, tmp_path):
    """Readers see whole saves only: details without a row are ignored, the last row wins."""
    df = tag(spark.createDataFrame(frames.turbines()), F.col("date") >= "2023-08-09")
    store = RunStore(spark, f"file:{tmp_path}/store")
    stamp = lambda minute: F.lit(f"2024-11-01 12:{minute:02d}:00").cast("timestamp")
    assert rebuild(store, "RUN-7") is None
    first = investigate(df, "stalled", ["model"], [], "RUN-7")
    first.save(store, "First", "turbines", stamp(0))
    second = investigate(df, "stalled", ["model", "site"], ["heat"], "RUN-7")
    store.write_details(second.details())  # the writer is lost before the row

    def lines(run):
        return sorted(map(tuple, run.lines.collect()))

    assert lines(rebuild(store, "RUN-7")) == lines(first)
    assert store.orphans("contributions").count() == 1
    second.save(store, "Second", "turbines", stamp(1))
    again = rebuild(store, "RUN-7")
    assert lines(again) == lines(second) and again.tagged is None
    assert again.nodes.count() == second.nodes.count() and again.curve.count() == second.curve.count()
    assert again.audit(stamp(2)).count() == second.audit(stamp(2)).count()
    assert store.all_details("contributions").count() == second.contributions.count()
    assert [r["title"] for r in store.runs.list().collect()] == ["Second"]
    assert store.runs.delete(spark.createDataFrame([("RUN-7",)], "id string"), stamp(3)) == 1
    assert rebuild(store, "RUN-7") is None and store.all_details("contributions").isEmpty()


def test_writers_with_one_version_agree(spark):
    rows = spark.createDataFrame(
        [("r", "t", 3, False, c) for c in ("c-1", "c-2")], "id string, saved_at string, version long, deleted boolean, commit string"
    )
    assert {current(rows.repartition(n)).first()["commit"] for n in (1, 5)} == {"c-2"}


def test_stall_spike(spark):
    df = tag(spark.createDataFrame(frames.turbines()), F.col("date") >= "2023-08-09")
    run = investigate(df, "stalled", ["model", "site"], ["heat"])
    assert run.window.first()["direction"] == "spike"
    supported = run.hypotheses.filter("status = 'supported'").toPandas()
    assert "C3" in set(supported["dimension_value"])
    assert "heat" in set(supported["dimension"])
    worst = run.contributions.orderBy(F.desc(F.abs("contribution"))).first()
    assert worst["is_primary"]
