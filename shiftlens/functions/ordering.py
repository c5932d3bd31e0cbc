"""Global order without a single-partition sort.

Two tools:

* ``in_buckets`` cuts a numeric column at fixed split points. Buckets keep the
  order of values, so running counts need only a window inside a bucket plus the
  totals of the buckets before it. Split points affect balance, never results.
* ``ordered_rows`` range-partitions rows by a unique key, writes the assignment
  down so that it cannot change under a retry, and numbers rows globally.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.session import bucket_count, materialize

BUCKET = "_bucket"
FAN_IN = 64
PLACE = "_place"
Cuts = dict[str | None, list[float]]


def cuts_of(column: Column, n: int) -> Column:
    """Approximate i/n quantiles; the sketch error is a tenth of a bucket."""
    return F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n)


def by_task(df: DataFrame) -> DataFrame:
    """Rows with one of ``FAN_IN`` numbers of the task that reads them."""
    return df.withColumn("_task", F.spark_partition_id() % FAN_IN)


def split_points(df: DataFrame, value: str, by: str | None = None) -> Cuts:
    """Approximate quantiles of ``value``, per key of ``by`` (a column of few keys).

    Sketches are merged in two levels, first by groups of tasks and then over the
    quantiles of the groups, so that no task merges one sketch per task. Only
    ``bucket_count`` numbers per key reach the driver.
    """
    n, keys = bucket_count(df.sparkSession), [by] if by else []
    parts = by_task(df.select(*keys, F.col(value).alias("_x"))).groupBy(*keys, "_task").agg(cuts_of(F.col("_x"), n).alias("cuts"))
    merged = parts.select(*keys, F.explode("cuts").alias("_x")).groupBy(*keys).agg(cuts_of(F.col("_x"), n).alias("cuts"))
    if by is None:
        row = merged.first()
        return {None: sorted(set((row and row["cuts"]) or []))}
    found = {row[by]: sorted(set(row["cuts"] or [])) for row in merged.collect()}
    return {**{row[by]: [] for row in df.select(by).distinct().collect()}, **found}


def column_split_points(df: DataFrame, columns: dict[str, Column]) -> Cuts:
    """Split points of several columns in one pass over the wide table."""
    n = bucket_count(df.sparkSession)
    named = [f"_c{i}" for i in range(len(columns))]
    wide = df.select(*[c.alias(k) for k, c in zip(named, columns.values())])
    parts = by_task(wide).groupBy("_task").agg(*[cuts_of(F.col(k), n).alias(k) for k in named])
    long = parts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("cuts")) for k in named])))
    merged = long.select("k", F.explode("cuts").alias("x")).groupBy("k").agg(cuts_of(F.col("x"), n).alias("cuts"))
    found = {row["k"]: sorted(set(row["cuts"])) for row in merged.collect()}
    return {name: found.get(k, []) for k, name in zip(named, columns)}


def _find(edges: np.ndarray, values: pd.Series, own_bucket: bool) -> np.ndarray:
    upto = np.searchsorted(edges, values, side="right")
    if own_bucket:
        upto = 2 * upto + (np.searchsorted(edges, values, side="left") == upto)
    return upto


def bucket_of(value: Column, cuts: list[float], own_bucket: bool = False) -> Column:
    """The number of split points at or below ``value``.

    With ``own_bucket`` a value equal to a split point gets an even bucket of its
    own. Every value held by more than about 1.2/n of the rows is a split point,
    so the odd buckets between them stay small whatever the skew.

    An Arrow batch search: Spark has no built-in search in a list of edges, and a
    binary search spelled out in column expressions measured ten times slower.
    """
    edges = np.asarray(cuts, dtype="float64")

    @F.pandas_udf(T.IntegerType())
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(_find(edges, values, own_bucket))

    return place(value)


def in_buckets(
    df: DataFrame, value: str, cuts: Cuts, by: str | None = None, own_bucket: bool = False
) -> DataFrame:
    """Add ``_bucket`` from the split points of the row's key; see ``bucket_of``."""
    if by is None:
        return df.withColumn(BUCKET, bucket_of(F.col(value), cuts[None], own_bucket))
    edges = {key: np.asarray(own, dtype="float64") for key, own in cuts.items()}
    none = np.asarray([], dtype="float64")

    @F.pandas_udf(T.IntegerType())
    def place(keys: pd.Series, values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), dtype="int32")
        codes, found = pd.factorize(keys)
        for code, key in enumerate(found):
            rows = codes == code
            out[rows] = _find(edges.get(key, none), values[rows], own_bucket)
        return pd.Series(out)

    return df.withColumn(BUCKET, place(F.col(by), F.col(value)))


def _before(columns: list[str]) -> Window:
    return Window.partitionBy(*columns).rowsBetween(Window.unboundedPreceding, -1)


def bucket_offsets(counted: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Per (by, bucket): weight in the bucket, in earlier buckets and in all buckets.

    At most ``bucket_count`` rows per key, so the window and a broadcast are bounded.
    """
    totals = counted.groupBy(*by, BUCKET).agg(F.sum(weight).alias("_inside"))
    earlier = F.sum("_inside").over(_before(by).orderBy(BUCKET))
    return totals.withColumn("_earlier", F.coalesce(earlier, F.lit(0))).withColumn(
        "_all", F.sum("_inside").over(Window.partitionBy(*by))
    )


def rank_totals(rows: DataFrame, by: str, sides: dict[str, str]) -> DataFrame:
    """(by, side, bucket) -> rows in the bucket, in earlier buckets, in all buckets.

    ``sides`` maps a side to its bucket column. Counted map-side in one pass over
    ``rows`` and written down; a few rows per key and split point.
    """
    pairs = [F.struct(F.lit(s).alias("_side"), F.col(c).alias(BUCKET)) for s, c in sides.items()]
    listed = rows.select(by, F.explode(F.array(*pairs)).alias("_p")).select(by, "_p.*")
    counted = listed.groupBy(by, "_side", BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    return materialize(bucket_offsets(counted, [by, "_side"], "_n"), "rank-totals")


def mid_rank(rows: DataFrame, by: str, value: str, bucket: str, totals: DataFrame, sort: bool = True) -> DataFrame:
    """Add ``rank_{value}``, the average rank among all rows of the same key, and ``_all``.

    A value with a bucket of its own has its rank from the totals alone, and its
    rows are spread over many tasks. Only values between split points are sorted;
    ``sort`` False says that ``rows`` has none of those.
    """
    side = totals.filter(F.col("_side") == value).withColumnRenamed(BUCKET, bucket).drop("_side")
    local = (F.col("_inside") + 1) / 2
    if sort:
        n = bucket_count(rows.sparkSession)
        alone = F.col(bucket) % 2 == 0
        others = [c for c in rows.columns if c not in (by, value, bucket)]
        salt = F.when(alone, F.pmod(F.xxhash64(*others), F.lit(4 * n)) + 1).otherwise(0)
        inside = Window.partitionBy(bucket, "_salt", by).orderBy(value)
        upto = F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        rows = (
            rows.withColumn("_salt", salt)
            .withColumn("_local", (F.rank().over(inside) + upto) / 2)
            .drop("_salt")
        )
        local = F.when(alone, local).otherwise(F.col("_local"))
    return (
        rows.drop("_all").join(F.broadcast(side), [by, bucket])
        .withColumn(f"rank_{value}", F.col("_earlier") + local)
        .drop("_local", "_earlier", "_inside")
    )


def rank_columns(rows: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns ``rank_{value}``: the average rank of each value among all values of its column, NULL for NULL.

    ``columns`` maps a name to its value and bucket column. A column whose values all have
    buckets of their own is ranked from bucket totals alone. For each other column the rows
    are shuffled once, by bucket; rows that need no sort there are spread by a number from the scan.
    """
    kept = [F.when(F.col(v).isNotNull(), F.col(b)).alias(b) for v, b in columns.values()]
    rows = rows.select(*[v for v, _ in columns.values()], *kept)
    entries = [F.struct(F.lit(k).alias("_side"), F.col(b).alias(BUCKET)) for k, (_, b) in columns.items()]
    listed = rows.select(F.inline(F.array(*entries))).filter(F.col(BUCKET).isNotNull())
    counted = listed.groupBy("_side", BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    totals = materialize(bucket_offsets(counted, ["_side"], "_n"), "rank-totals")
    sorted_sides = {row["_side"] for row in totals.filter(F.col(BUCKET) % 2 == 1).select("_side").distinct().collect()}
    carried = [c for k, (v, b) in columns.items() for c in ([v, b] if k in sorted_sides else [b])]
    spread = F.monotonically_increasing_id() % F.lit(4 * bucket_count(rows.sparkSession)) + 1
    rows = rows.select(*carried, spread.cast("int").alias("_spread"))
    for name in (k for k in columns if k in sorted_sides):
        value, bucket = columns[name]
        inside = Window.partitionBy(bucket, "_salt").orderBy(value)
        upto = F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("_salt", F.when(F.col(bucket) % 2 == 1, 0).otherwise(F.col("_spread")))
        rows = rows.withColumn(f"rank_{value}", (F.rank().over(inside) + upto) / 2).drop(value, "_salt")
    for name, (value, bucket) in columns.items():
        side = totals.filter(F.col("_side") == name).select(F.col(BUCKET).alias(bucket), "_earlier", "_inside")
        local = (F.col("_inside") + 1) / 2
        if name in sorted_sides:
            local = F.when(F.col(bucket) % 2 == 0, local).otherwise(F.col(f"rank_{value}"))
        rows = rows.join(F.broadcast(side), bucket, "left").withColumn(f"rank_{value}", F.col("_earlier") + local)
        rows = rows.drop(bucket, "_earlier", "_inside")
    return rows.drop("_spread")


def exact_quantiles(
    counted: DataFrame,
    by: list[str],
    value: str,
    weight: str,
    probabilities: dict[str, float],
) -> DataFrame:
    """Exact quantiles with linear interpolation from (key, value, count) rows.

    ``counted`` holds each value once per key and a ``_bucket`` column. Only the
    buckets that hold a wanted position are sorted.
    """
    offsets = bucket_offsets(counted, by, weight)
    first, last = F.col("_earlier"), F.col("_earlier") + F.col("_inside") - 1
    wanted = F.lit(False)
    for share in probabilities.values():
        position = F.lit(share) * (F.col("_all") - 1)
        wanted = wanted | (F.floor(position).between(first, last)) | (F.ceil(position).between(first, last))
    kept = offsets.filter(wanted).drop("_inside")
    local = F.coalesce(F.sum(weight).over(_before([*by, BUCKET]).orderBy(value)), F.lit(0))
    placed = (
        counted.join(F.broadcast(kept), [*by, BUCKET])
        .withColumn("_below", F.col("_earlier") + local)
        .withColumn("_upto", F.col("_below") + F.col(weight) - 1)
    )
    picks = [F.max("_all").alias("n_values")]
    for name, share in probabilities.items():
        position = F.lit(share) * (F.col("_all") - 1)
        for edge, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = rank.between(F.col("_below"), F.col("_upto"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{edge}"))
    out = placed.groupBy(*by).agg(*picks)
    for name, share in probabilities.items():
        position = F.lit(share) * (F.col("n_values") - 1)
        part = position - F.floor(position)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, low + (high - low) * part)
    return out.select(*by, "n_values", *probabilities)


def ordered_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows sorted by a unique ``key`` across range partitions, written down.

    ``_bucket`` is the range and ``_place`` the position in it, counted from zero
    while the sorted range is written; no window and no second shuffle is needed.
    """
    spread = df.repartitionByRange(bucket_count(df.sparkSession), *key).sortWithinPartitions(*key)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return materialize(spread.withColumn(BUCKET, F.spark_partition_id()).withColumn(PLACE, place), "ordered")


def with_row_number(ordered: DataFrame, name: str = "row_number") -> DataFrame:
    """Global 1-based position of each row of an ``ordered_rows`` table."""
    sizes = ordered.groupBy(BUCKET).agg((F.max(PLACE) + 1).alias("_size"))
    whole = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(BUCKET, F.coalesce(F.sum("_size").over(whole), F.lit(0)).alias("_earlier"))
    number = (F.col(PLACE) + 1 + F.col("_earlier")).cast("long")
    return ordered.join(F.broadcast(offsets), BUCKET).withColumn(name, number).drop("_earlier", BUCKET, PLACE)


def backfill(ordered: DataFrame, value: str) -> DataFrame:
    """Replace a NULL ``value`` of an ``ordered_rows`` table by the next non-null one, else by zero.

    Inside a bucket by a window that runs from its end, so that the growing frame
    stays linear; past its end from the first value of a later bucket. A table
    without gaps is returned as it is.
    """
    if ordered.filter(F.col(value).isNull()).isEmpty():
        return ordered
    earliest = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(PLACE)))
    firsts = ordered.groupBy(BUCKET).agg(earliest.alias("_first"))
    later = Window.orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    following = firsts.select(BUCKET, F.last("_first", ignorenulls=True).over(later).alias("_later"))
    inside = (
        Window.partitionBy(BUCKET).orderBy(F.desc(PLACE))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ordered.withColumn(value, F.last(value, ignorenulls=True).over(inside))
        .join(F.broadcast(following), BUCKET)
        .withColumn(value, F.coalesce(value, "_later", F.lit(0.0)))
        .drop("_later")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
