"""Column expressions shared by the operators that stay inside DataFrame functions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACED_WORD = r"[^\x20\x09-\x0D]+"
KEY = ["_key_a", "_key_b"]
ROW = "_row"
BROADCAST_ENTRIES = 500_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay. The slow path is taken by texts beyond ASCII only."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, pattern: str) -> Column:
    """All matches of ``pattern``; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def with_key(docs: DataFrame, *columns: str) -> DataFrame:
    """128 bits of hash over ``columns``: rows that are equal there share the key."""
    named = [F.col(f"`{c}`") for c in columns]
    return docs.withColumn(KEY[0], F.xxhash64(F.lit(1), *named)).withColumn(KEY[1], F.xxhash64(F.lit(2), *named, F.lit(3)))


def sealed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and all others in one struct, so that no other input name can clash."""
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in columns]
    return docs.select(*columns, (F.struct(*others) if others else F.lit(True)).alias(ROW))


def unsealed(docs: DataFrame, columns: list[str], beside: tuple[str, ...] = ("doc_id", "text"), **new: Column) -> DataFrame:
    """The columns of sealed rows, of which ``beside`` stood beside the struct; those in ``new`` replaced or added."""
    place = {c: f"_new_{k}" for k, c in enumerate(new)}
    made = docs.select(ROW, *beside, *(value.alias(place[c]) for c, value in new.items()))
    old = [F.col(place[c] if c in new else c if c in beside else f"{ROW}.`{c}`").alias(c) for c in columns]
    return made.select(*old, *(F.col(place[c]).alias(c) for c in new if c not in columns))


def sized(rows: DataFrame, entries: str) -> DataFrame:
    """Rows for a join, broadcast only if their lists hold at most ``BROADCAST_ENTRIES`` entries in all."""
    total = rows.agg(F.sum(F.size(entries) + 1).alias("n")).first()["n"] or 0
    return F.broadcast(rows) if total <= BROADCAST_ENTRIES else rows
