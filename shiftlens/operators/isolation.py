"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Trees are grown from hash-ordered subsamples of 256 rows, one task per tree. A hash of
(tree, node) draws the feature and the cut of each node, so that nothing is random but
hashes and SQL can grow the same forest level by level. Node n has the children 2 n and
2 n + 1. Path lengths are whole millionths, so sums over trees do not depend on their
order. The grown forest is small by construction (100 trees of at most 511 nodes), so it
travels with the scoring function, which grades every row in Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.numeric import NUMERIC_TYPES, named, number
from shiftlens.functions.ordering import exact_quantiles, in_buckets, split_points
from shiftlens.operators.cleaning import complete_rows
from shiftlens.operators.cohorts import tag, window_summary
from shiftlens.session import materialize

TREES = 100
SAMPLE = 256
SEED = 42
CONTAMINATION = 0.05
MIN_ROWS = 20
POOL = TREES * SAMPLE
UNIT = 1_000_000
HASH_DIGITS = 15
NODE_SCHEMA = "tree int, node int, feature int, threshold double, path long"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def default_features(df: DataFrame, metric: str) -> list[str]:
    """All numeric columns besides the metric."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    return [c for c in numeric if c != metric]


def complete_features(df: DataFrame, metric: str, features: list[str]) -> DataFrame:
    """Rows with a number in the metric and in every feature."""
    columns = [metric, *features]
    numbers = df.select(*[number(c).alias(c) if c in columns else F.col(c) for c in df.columns])
    return complete_rows(numbers, columns)


def hashed(*parts: Column | str | int) -> Column:
    """60 bits of MD5 over the parts as text, joined by colons; NULL counts as empty."""
    texts = [F.coalesce((F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, HASH_DIGITS), 16, 10).cast("long")


def leaf_paths() -> list[int]:
    """Path below a leaf of n rows in millionths, for n up to the sample size."""
    return [round(average_path(n) * UNIT) for n in range(SAMPLE + 1)]


def dealt_sample(complete: DataFrame, columns: list[str], key: list[str], n: int) -> DataFrame:
    """(tree, f0, f1, ...): the rows each tree is grown from.

    A hash of the key draws them, so they do not depend on how the data is
    partitioned: first a share of the rows that holds about four times the 25 600
    wanted ones, then the smallest hashes of those. Trees take turns through them
    in hash order, 256 rows each, and start over when the rows run out.
    """
    draw = hashed(SEED, *key)
    limit = F.lit(int(min(1.0, 4.0 * POOL / n) * 16**HASH_DIGITS))
    features = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(columns)]
    pool = complete.select(draw.alias("_hash"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), *features).filter(F.col("_hash") < limit)
    order = ["_hash", *(f"_k{i}" for i in range(len(key)))]
    pool = pool.orderBy(*order).limit(POOL)
    place = (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")
    placed = pool.withColumn("_place", place).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy()))
    share = F.least(F.lit(SAMPLE), F.col("_size"))
    turns = F.sequence(F.col("_place"), F.lit(TREES) * share - 1, F.col("_size"))
    dealt = placed.withColumn("_turn", F.explode(F.when(F.col("_place") < TREES * share, turns)))
    names = [f"f{i}" for i in range(len(columns))]
    return dealt.select(F.floor(F.col("_turn") / share).cast("int").alias("tree"), *names)


def _drawn(*parts: int) -> int:
    """The same number as ``hashed`` gives for whole numbers."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:HASH_DIGITS], 16)


def _grow(rows: pd.DataFrame, names: list[str], depth_limit: int) -> pd.DataFrame:
    """Nodes of one isolation tree, in the order of their numbers."""
    tree = int(rows["tree"].iloc[0])
    values = rows[names].to_numpy(dtype="float64")
    below, nodes = leaf_paths(), []
    waiting = [(1, 0, np.arange(len(values)))]
    for node, depth, members in waiting:
        part = values[members]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(members) <= 1 or usable.size == 0:
            nodes.append((tree, node, None, None, depth * UNIT + below[len(members)]))
            continue
        feature = int(usable[_drawn(SEED, tree, node, 1) % usable.size])
        share = _drawn(SEED, tree, node, 2) / float(16**HASH_DIGITS)
        cut = float(low[feature] + share * (high[feature] - low[feature]))
        nodes.append((tree, node, feature, cut, None))
        right = part[:, feature] > cut
        waiting += [(2 * node + side, depth + 1, own) for side, own in ((0, members[~right]), (1, members[right])) if len(own)]
    grown = pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "path"])
    return grown.astype({"feature": "Int32", "path": "Int64"})


def grow_forest(complete: DataFrame, columns: list[str], key: list[str], n: int) -> DataFrame:
    """(tree, node, feature, threshold, path): leaves have no feature, inner nodes no path."""
    names = [f"f{i}" for i in range(len(columns))]
    depth_limit = max(1, math.ceil(math.log2(min(SAMPLE, max(n, 2)))))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        return _grow(rows, names, depth_limit)

    return dealt_sample(complete, columns, key, n).groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def _pack(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """Arrays by (tree, node); a child that no row of the sample reached ends at its depth."""
    depth = np.floor(np.log2(np.maximum(np.arange(4 * SAMPLE), 1))).astype("int64")
    packed = {
        "feature": np.full((TREES, len(depth)), -1, "int64"),
        "threshold": np.zeros((TREES, len(depth))),
        "path": np.tile(depth * UNIT, (TREES, 1)),
    }
    for name, rows in (("feature", nodes[nodes["feature"].notna()]), ("threshold", nodes[nodes["feature"].notna()]), ("path", nodes[nodes["path"].notna()])):
        packed[name][rows["tree"].astype(int), rows["node"].astype(int)] = rows[name]
    return packed


def _path_sums(values: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """Sum of the path lengths of each row over all trees, level by level."""
    total = np.zeros(len(values), "int64")
    rows = np.arange(len(values))
    for tree in range(TREES):
        feature, threshold = forest["feature"][tree], forest["threshold"][tree]
        at = np.ones(len(values), dtype="int64")
        inner = feature[at] >= 0
        while inner.any():
            chosen = feature[at]
            right = values[rows, np.maximum(chosen, 0)] > threshold[at]
            at = np.where(inner, 2 * at + right, at)
            inner = feature[at] >= 0
        total += forest["path"][tree][at]
    return total


def score_rows(complete: DataFrame, columns: list[str], nodes: DataFrame, n_sample: int) -> DataFrame:
    """Every complete row with ``anomaly_score`` in (0, 1]; higher is more anomalous.

    Only the feature columns travel to Python.
    """
    forest = _pack(nodes.toPandas())
    norm = average_path(n_sample) * TREES * UNIT

    @F.pandas_udf("double")
    def score(features: pd.DataFrame) -> pd.Series:
        values = features.to_numpy(dtype="float64")
        return pd.Series(np.exp2(-_path_sums(values, forest) / norm))

    return complete.withColumn("anomaly_score", score(F.struct(*columns)))


def score_threshold(scored: DataFrame, contamination: float) -> DataFrame:
    """One row: the exact score quantile above which rows are flagged."""
    counted = scored.groupBy("anomaly_score").agg(F.count(F.lit(1)).alias("n")).withColumn("_all_rows", F.lit(1))
    bucketed = in_buckets(counted, "anomaly_score", split_points(scored, "anomaly_score"))
    quantile = exact_quantiles(bucketed, ["_all_rows"], "anomaly_score", "n", {"cut": 1.0 - contamination})
    return quantile.select("cut")


def forest_points(
    df: DataFrame,
    metric: str,
    key: list[str],
    features: list[str] | None = None,
    contamination: float = CONTAMINATION,
) -> DataFrame | None:
    """Complete rows with score, flag, z against inliers and severity; None below 20 rows.

    ``key`` identifies a row and decides which rows the trees are grown from.
    """
    features = default_features(df, metric) if features is None else features
    columns = [metric, *features]
    own_key = [f"_key{i}" for i in range(len(key))]
    keyed = df.withColumns({k: named(c) for k, c in zip(own_key, key)})
    complete = complete_features(keyed, metric, features).select(*own_key, *(named(c) for c in dict.fromkeys([*key, *columns])))
    complete = materialize(complete, "complete")
    n = complete.count()
    if n < MIN_ROWS:
        return None
    nodes = grow_forest(complete, columns, own_key, n)
    scored = materialize(score_rows(complete, columns, nodes, min(SAMPLE, n)), "scores")
    marked = scored.withColumn("is_anomaly", F.col("anomaly_score") > score_threshold(scored, contamination).scalar())
    marked = materialize(marked, "flags")
    inliers = marked.filter(~F.col("is_anomaly")).agg(
        F.struct(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(1.0)).alias("std")).alias("s")
    )
    z = (F.col(metric) - F.col("_s.mean")) / (F.col("_s.std") + 1e-9)
    severity = F.when(~F.col("is_anomaly"), "normal").when(F.abs("z") > 3.0, "critical").otherwise("high")
    return (
        marked.withColumn("_s", inliers.scalar())
        .withColumn("z", z)
        .withColumn("expected", F.col("_s.mean"))
        .withColumn("severity", severity)
        .withColumn("deviation_z", F.round("z", 2))
        .drop("_s", *own_key)
    )


def forest_window(points: DataFrame, metric: str) -> DataFrame:
    """Inliers against flagged rows, as a one-row summary."""
    tagged = tag(points, F.col("is_anomaly"))
    flagged = points.agg(F.count_if("is_anomaly").alias("n")).scalar()
    summary = window_summary(tagged, metric, "isolation_forest", flagged)
    return summary.withColumn(
        "baseline_label", F.format_string("Inlier Cohort (N=%d)", "baseline_count")
    ).withColumn(
        "anomaly_label", F.format_string("Isolation Forest Anomaly Cluster (N=%d)", "anomaly_count")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
