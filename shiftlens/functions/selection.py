"""Exact quantiles of many columns by selection, without a table of their values.

Three scans of the wide table, all in JVM expressions:

1. sketches give two pivots around every wanted quantile,
2. one aggregate counts the rows below and up to each pivot,
3. only values of the zone that holds the wanted rows are shuffled, counted map-side;
   none where the pivots are one value that holds the position.

Pivots decide how much is shuffled, never the result: the counts tell which of the
three zones (below, between, above) holds a position, wherever the pivots fell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.ordering import by_task, cuts_of
from shiftlens.session import bucket_count


def _pivots(wide: DataFrame, names: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Per column approximate quantiles a little below and above each share.

    Sketches of groups of tasks are merged by exact percentiles of their cut points,
    weighted with the rows of the group; one row per column reaches the driver.
    """
    n = bucket_count(wide.sparkSession)
    around = [min(1.0, max(0.0, share + step / n)) for share in shares for step in (-2, 2)]
    sizes = [F.count(c).alias(f"n{c}") for c in names]
    parts = by_task(wide).groupBy("_task").agg(*[cuts_of(F.col(c), n).alias(c) for c in names], *sizes)
    listed = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("cuts"), F.col(f"n{c}").alias("w")) for c in names])
    points = parts.select(F.inline(listed)).select("c", "w", F.explode("cuts").alias("x"))
    merged = points.groupBy("c").agg(F.percentile("x", around, F.col("w")).alias("x"))
    return {row["c"]: row["x"] for row in merged.collect()}


def _zone(x: Column, low: float, high: float, below: int, upto: int, first: int, last: int) -> tuple[int, Column]:
    """Rows before the zone that holds positions ``first`` to ``last``, and its condition."""
    inside = x.isNotNull()
    earlier = 0
    if first >= upto:
        earlier, inside = upto, inside & (x > high)
    elif first >= below:
        earlier, inside = below, inside & (x >= low)
    if last < below:
        inside = inside & (x < low)
    elif last < upto:
        inside = inside & (x <= high)
    return earlier, inside


def select_quantiles(
    df: DataFrame, cells: dict[str, Column], probabilities: dict[str, float], by: str = "column"
) -> DataFrame:
    """One row per entry of ``cells`` with its exact quantiles, linearly interpolated.

    ``cells`` maps a name to a double expression over ``df``; NULL is left out and
    NaN must not occur. Names without any value give no row. ``df`` must give the same
    rows whenever it is read. The driver reads a few numbers per name and probability.
    """
    spark = df.sparkSession
    names = {f"c{i}": name for i, name in enumerate(cells)}
    wide = df.select(*[cell.cast("double").alias(c) for c, cell in zip(names, cells.values())])
    pivots = _pivots(wide, list(names), list(probabilities.values())) if names else {}
    counted = []
    for c, points in pivots.items():
        counted.append(F.count(c).alias(c))
        for i, (low, high) in enumerate(zip(points[::2], points[1::2])):
            counted += [F.count_if(F.col(c) < low).alias(f"{c}b{i}"), F.count_if(F.col(c) <= high).alias(f"{c}u{i}")]
    found = wide.agg(*counted).first() if counted else None

    bases, picked = [], []
    for c, points in pivots.items():
        for i, (label, share) in enumerate(probabilities.items()):
            place = share * (found[c] - 1)
            first, last = math.floor(place), math.ceil(place)
            low, high = points[2 * i], points[2 * i + 1]
            below, upto = found[f"{c}b{i}"], found[f"{c}u{i}"]
            sure = low if low == high and below <= first and last < upto else None
            earlier, inside = _zone(F.col(c), low, high, below, upto, first, last)
            g = len(bases)
            bases.append((g, names[c], label, found[c], earlier, first, last, place - first, sure))
            if sure is None:
                picked.append(F.when(inside, F.struct(F.lit(g).alias("g"), F.col(c).alias("x"))))
    wanted = spark.createDataFrame(
        bases,
        "g int, name string, q string, n_values long, earlier long, first long, last long, part double, sure double",
    )
    zones = F.array_compact(F.array(*picked)) if picked else F.lit(None).cast("array<struct<g:int,x:double>>")
    values = wide.select(F.explode(zones).alias("v")).groupBy("v.g", "v.x")
    before = Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.agg(F.count(F.lit(1)).alias("n")).withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    start = F.col("earlier") + F.col("inside")
    hits = [
        F.max(F.when(F.col(rank).between(start, start + F.col("n") - 1), F.col("x"))).alias(edge)
        for rank, edge in (("first", "low"), ("last", "high"))
    ]
    edges = wanted.join(placed.join(F.broadcast(wanted), "g").groupBy("g").agg(*hits), "g", "left")
    value = F.coalesce(F.col("sure"), F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    return edges.groupBy(F.col("name").alias(by)).agg(
        F.max("n_values").alias("n_values"),
        *[F.max(F.when(F.col("q") == label, value)).alias(label) for label in probabilities],
    )
