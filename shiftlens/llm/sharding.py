"""Sharding by a keyed permutation of global row numbers.

Rows get gapless numbers in the order of a 128-bit hash over all their columns, so
the numbers depend on content only. A Feistel network over a grid of about n cells,
walked again while it leaves 0..n-1, permutes them; ``shard`` is the result modulo
the number of shards and ``slot`` the quotient. Both can be computed from a row
number, and back, without a table. Shard sizes differ by at most one row.

Repeated rows are counted first and numbered next to each other, so they never meet
in one task; a NULL text has no bytes; columns named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.llm.native import KEY, ROW, sealed, with_key

ROUNDS = 6
PRIME = 2**31 - 1
BUCKET_ROWS = 20_000
RESULT = ["row_number", "position", "shard", "slot"]


def grid(n: int) -> tuple[int, int]:
    """Sides whose product is at least ``n`` and less than ``n`` plus the first."""
    side = math.isqrt(max(n, 1) - 1) + 1
    return side, -(-max(n, 1) // side)


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers per round, drawn from the seed by a linear generator."""
    state, keys = seed % PRIME, []
    for _ in range(ROUNDS):
        drawn = []
        for _ in range(3):
            state = (state * 48271 + 12345) % PRIME
            drawn.append(state or 1)
        keys.append(tuple(drawn))
    return keys


def _mix(x: Column, a: Column, b: Column, c: Column) -> Column:
    """Twice squared modulo a prime: stays within 64 bits."""
    first = (F.pmod(x, F.lit(PRIME)) * a + b) % F.lit(PRIME)
    second = (first * first + c) % F.lit(PRIME)
    return (second * second + a) % F.lit(PRIME)


def _round(state: Column, key: Column, rows: int, columns: int, sign: int) -> Column:
    left, right = state["l"], state["r"]
    shift = F.when(key["even"], _mix(right, key["a"], key["b"], key["c"])).otherwise(_mix(left, key["a"], key["b"], key["c"]))
    return F.struct(
        F.when(key["even"], F.pmod(left + sign * shift, F.lit(rows))).otherwise(left).alias("l"),
        F.when(key["even"], right).otherwise(F.pmod(right + sign * shift, F.lit(columns))).alias("r"),
    )


def _network(x: Column, n: int, seed: int, inverse: bool) -> Column:
    rows, columns = grid(n)
    keys = [(k % 2 == 0, *abc) for k, abc in enumerate(round_keys(seed))]
    literal = F.array(*(
        F.struct(F.lit(e).alias("even"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c"))
        for e, a, b, c in (reversed(keys) if inverse else keys)
    ))
    wide = F.lit(columns).cast("long")
    start = F.struct(F.floor(x / wide).cast("long").alias("l"), F.pmod(x, wide).alias("r"))
    end = F.aggregate(literal, start, lambda s, k: _round(s, k, rows, columns, -1 if inverse else 1))
    return end["l"] * wide + end["r"]


def permuted(number: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """``number`` in 0..n-1 to its place in 0..n-1, one to one.

    A walk meets each of the fewer than ``grid(n)[0]`` cells outside 0..n-1 at most
    once, which bounds it; only the few numbers that leave the range walk at all.
    """
    rows, columns = grid(n)
    outside = rows * columns - n
    first = F.element_at(F.transform(F.array(number.cast("long")), lambda x: _network(x, n, seed, inverse)), 1)
    if not outside:
        return first
    walk = F.sequence(F.lit(1), F.lit(outside))
    return F.element_at(
        F.transform(
            F.array(first),
            lambda x: F.when(x < n, x).otherwise(
                F.aggregate(walk, x, lambda y, _: F.when(y < n, y).otherwise(_network(y, n, seed, inverse)))
            ),
        ),
        1,
    )


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with a gapless ``row_number`` from 0 that depends on their content, and their count."""
    columns = docs.columns
    keyed = with_key(sealed(docs), ROW)
    n = docs.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / BUCKET_ROWS))) if n else 0
    bucket = F.shiftrightunsigned(KEY[0], 64 - bits) if bits else F.lit(0).cast("long")
    counts = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_bucket", bucket)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("_bucket").agg(F.sum("_copies").alias("_inside"))
    offsets = totals.select("_bucket", F.coalesce(F.sum("_inside").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("_bucket").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_local", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    starts = starts.join(offsets, "_bucket").select(*KEY, "_copies", (F.col("_earlier") + F.col("_local")).alias("_start"))
    distinct = keyed.groupBy(*KEY).agg(F.any_value(ROW).alias(ROW))
    placed = distinct.join(starts, KEY)
    copies = F.sequence(F.col("_start"), F.col("_start") + F.col("_copies") - 1)
    return placed.select("_row", F.explode(copies).alias("_number")).select(
        *(F.col(f"_row.`{c}`").alias(c) for c in columns if c not in RESULT), F.col("_number").alias("row_number")
    ), n


def shard(docs: DataFrame, shards: int, seed: int = 20240229) -> DataFrame:
    """The documents with ``row_number``, ``position``, ``shard`` and ``slot``."""
    rows, n = numbered(docs)
    position = permuted(F.col("row_number"), n, seed)
    placed = rows.withColumn("position", position)
    return placed.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("position") / shards).cast("long")
    )


def row_at(shard_id: Column, slot: Column, n: int, shards: int, seed: int = 20240229) -> Column:
    """Row number that lies at a slot of a shard."""
    return permuted(slot * shards + shard_id, n, seed, inverse=True)
