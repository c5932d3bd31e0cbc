"""Ranks of several columns at once, and the work that runs of one table share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import frames
from shiftlens.operators import hypotheses as hyp
from shiftlens.operators import statistics as st
from shiftlens.plans import batch

NAMES = ["y", "same", "holes", "few", "flat", "none"]


def table(seed=1, n=3000):
    draw = np.random.default_rng(seed)
    gone = np.arange(n) % 11 == 0
    y = np.where(gone, np.nan, np.round(draw.normal(size=n), 2))
    same = np.where(gone, np.nan, np.where(draw.random(n) < 0.4, 0.5, draw.random(n)) + 0.3 * np.nan_to_num(y))
    holes = np.where(draw.random(n) < 0.2, np.nan, draw.random(n) - 0.2 * np.nan_to_num(y))
    few = np.where(gone, np.nan, draw.integers(0, 4, n))
    return pd.DataFrame({"y": y, "same": same, "holes": holes, "few": few, "flat": np.where(gone, np.nan, 2.0), "none": np.nan})


def test_rank_correlations_of_columns_match_pandas(spark):
    frame = table()
    placed = hyp.placed_columns(spark.createDataFrame(frame).repartition(4), {}, NAMES)
    pairs = {c: (c, "y") for c in NAMES[1:]}
    got = {r["covariate"]: r for r in st.spearman_columns(placed, pairs, hyp.places(NAMES)).collect()}
    assert set(got) == {"same", "holes", "few", "flat"} and got["flat"]["rho"] is None
    for name in ("same", "holes", "few"):
        both = frame[["y", name]].dropna()
        assert got[name]["n_pairs"] == len(both)
        assert got[name]["rho"] == pytest.approx(both["y"].rank().corr(both[name].rank()), abs=1e-10)


def test_columns_without_rows(spark):
    placed = hyp.placed_columns(spark.createDataFrame(table()).limit(0), {}, NAMES)
    assert st.spearman_columns(placed, {"a": ("y", "few")}, hyp.places(NAMES)).count() == 0


def test_runs_share_pairs_and_windows(spark, monkeypatch):
    facts = spark.createDataFrame(frames.parcels(600))
    late = ["2023-03-11", "2023-03-05"]
    metrics = ["on_time", "fee_amount"]
    runs = [batch.Run(f"{m}{d}", m, F.col("date") >= d) for m in metrics for d in late]
    ranked, shifted = [], []
    columns, values = st.spearman_columns, hyp.shifted_values
    monkeypatch.setattr(st, "spearman_columns", lambda w, pairs, c: ranked.append(pairs) or columns(w, pairs, c))
    monkeypatch.setattr(hyp, "shifted_values", lambda p, keys, n: shifted.append(keys) or values(p, keys, n))
    found = batch.investigate_runs(facts, runs, ["carrier"], ["scan_latency", "fee_amount"])
    assert found.hypotheses.filter("family = 'covariate_drift'").count() == 6
    assert len(ranked[0]) == 3 and len(shifted[0]) == 4
