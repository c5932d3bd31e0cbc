"""Profiles of columns too large to count value by value: mergeable states and heavy hitters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.ordering import by_task
from shiftlens.operators.profiling import as_text, flat_fields, top_values, value_counts
from shiftlens.session import materialize

LG_BUCKETS = 14  # 16 KB a column
TRACKED = 1000
MOST_TRACKED = 100_000


# --- distinct counts that can be stored and added up -------------------------------------


def column_state(df: DataFrame, lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """(column, total_count, missing_count, sketch) over all flat columns, in one scan.

    A state of bounded size that can be stored and merged with states of other data.
    Values count as in the exact profile: as text, NaN as missing. Sketches are merged
    by groups of tasks first, so that no task merges one per task. Without columns the
    state is empty; without rows its counts are zero.
    """
    fields = flat_fields(df)
    texts = df.select(*[as_text(f).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.count(F.lit(1)).alias("total_count"),
            F.count_if(F.col(f"c{i}").isNull()).alias("missing_count"),
            F.hll_sketch_agg(F.col(f"c{i}"), F.lit(lg_buckets)).alias("sketch"),
        )
        for i, f in enumerate(fields)
    ]
    if not rows:
        return df.sparkSession.createDataFrame(
            [], "column string, total_count bigint, missing_count bigint, sketch binary"
        )
    parts = by_task(texts).groupBy("_task").agg(F.array(*rows).alias("states")).select(F.inline("states"))
    names = df.sparkSession.createDataFrame([(f.name,) for f in fields], "column string")
    return merge_states(names.join(parts, "column", "left"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state for the data of all; a column that some data lack counts where it occurs."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy("column").agg(
        F.coalesce(F.sum("total_count"), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum("missing_count"), F.lit(0)).alias("missing_count"),
        F.hll_union_agg("sketch").alias("sketch"),
    )


def distinct_estimates(state: DataFrame, lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """Estimated distinct values per column with three standard errors of a merged sketch."""
    return state.select(
        "column", "total_count", "missing_count",
        F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("unique_estimate"),
        F.lit(3 * 1.04 / 2 ** (lg_buckets / 2)).alias("error_share"),
    )


# --- most frequent values in two passes --------------------------------------------------


def _tracked(texts: DataFrame, names: list[str], tracked: int) -> DataFrame:
    """(column, value) of the counters that survive; at most ``tracked`` per column."""
    state = [F.expr(f"approx_top_k_accumulate({c}, {tracked})").alias(c) for c in names]
    parts = by_task(texts.select(*names)).groupBy("_task").agg(*state)
    merged = parts.agg(*[F.expr(f"approx_top_k_combine({c}, {tracked})").alias(c) for c in names])
    listed = [
        F.struct(F.lit(c).alias("column"), F.expr(f"transform(approx_top_k_estimate({c}, {tracked}), x -> x.item)").alias("values"))
        for c in names
    ]
    found = merged.select(F.inline(F.array(*listed)))
    return found.select("column", F.explode("values").alias("value")).filter(F.col("value").isNotNull())


def frequent_values(
    df: DataFrame, columns: list[str], k: int = 5, tracked: int = TRACKED, most: int = MOST_TRACKED
) -> DataFrame:
    """(column, value, n, rank): the exact ``k`` most frequent values, ties by value.

    Bounded counters, merged map-side, give candidates; a second pass counts those
    exactly. Any value held by more than 7 / ``tracked`` of the rows is a candidate, so a
    column is settled if its k-th count is above that share, or if its candidates hold
    all its values. The others are tried again with ten times the counters, and above
    ``most`` counted value by value. No distinct values are shuffled before that. NULL
    and NaN are no values; columns without any give no rows.
    """
    fields = {f.name: f for f in flat_fields(df)}
    names = {f"c{i}": name for i, name in enumerate(columns)}
    texts = df.select(*[as_text(fields[name]).alias(c) for c, name in names.items()])
    sizes = texts.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in names]).first()
    pending, done = [c for c in names if sizes[c]], []
    while pending and tracked <= most:
        wanted = materialize(_tracked(texts, pending, tracked), "tracked")
        long = texts.select(*pending).unpivot([], pending, "column", "value")
        counted = long.join(wanted, ["column", "value"]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
        counted = materialize(counted.withColumn("rank", F.row_number().over(order)), "counted")
        proofs = counted.groupBy("column").agg(F.sum("n").alias("held"), F.min(F.when(F.col("rank") == k, F.col("n"))).alias("last"))
        proof = {row["column"]: row for row in proofs.collect()}
        settled = []
        for c in pending:
            held, last = (proof[c]["held"], proof[c]["last"]) if c in proof else (0, None)
            if held == sizes[c] or (last is not None and last * tracked > 7 * sizes["rows"]):
                settled.append(c)
        done.append(counted.filter(F.col("column").isin(settled) & (F.col("rank") <= k)))
        pending = [c for c in pending if c not in settled]
        tracked *= 10
    if pending or not done:
        done.append(top_values(value_counts(texts.select(*pending)), k))
    out = reduce(DataFrame.unionByName, done)
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None).cast("map<string,string>")
    return out.withColumn("column", label[F.col("column")])
