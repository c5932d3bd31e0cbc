"""Benchmark decontamination by a hash set of the benchmark's n-grams.

A window is ``size`` consecutive words of an item, or a shorter item as a whole. Any
window of L words that stands in a document holds an aligned block of the document:
one that starts at a multiple of ``step`` = L div 2 and has L - step + 1 words. So
only aligned blocks are hashed and looked up among the benchmark's n-grams of that
length; a hit is verified by comparing the words of the few windows around it.

NULL and empty texts have no words, so no hits. Documents are told apart by
(doc_id, text); equal rows get equal results. Items with equal texts both count;
items without words or without an id count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.llm.native import KEY, lower_ascii, sealed, unsealed, with_key, words
from shiftlens.session import materialize

SIZE = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000


def _steps(length: int) -> tuple[int, int]:
    step = max(1, length // 2)
    return step, length - step + 1


def _runs(array: Column, count: Column, size: int) -> Column:
    """Places (from 0) where ``size`` consecutive elements fit; none in a shorter array."""
    return F.when(count >= size, F.sequence(F.lit(0), count - size)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, length, gram, grams of words): one row per window of each item, written once."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id"), words(lower_ascii(F.col("text")), WORD).alias("words")
    )
    items = items.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    placed = items.select("item_id", "length", "words", F.explode(starts).alias("at"))
    return placed.select("item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("gram")).distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only for a counted table within the bound; a shuffle join beyond."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(key, start, length, window) of every verified occurrence, and (window, item_id)."""
    windows = materialize(benchmark_windows(benchmark, size), "benchmark-windows")
    grams = windows.select("length", "gram").distinct().withColumn("window", F.monotonically_increasing_id())
    grams = materialize(grams, "benchmark-grams")
    members = windows.join(grams, ["length", "gram"]).select("window", "item_id")
    count = grams.count()
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())
    keyed = with_key(docs, "doc_id", "text").select(*KEY, words(lower_ascii(F.col("text")), WORD).alias("words"))
    found = None
    for length in lengths:
        step, block = _steps(length)
        own = grams.filter(F.col("length") == length)
        hashed = F.transform(_runs(F.col("gram"), F.size("gram"), block), lambda p: F.xxhash64(F.slice("gram", p + 1, block)))
        blocks = own.select(F.explode(hashed).alias("hash")).distinct()
        fits = F.floor((F.size("words") - block) / step).cast("int")
        aligned = F.when(F.size("words") >= length, F.sequence(F.lit(0), fits)).otherwise(F.array().cast("array<int>"))
        probes = F.transform(aligned, lambda k: F.xxhash64(F.slice("words", k * step + 1, block)))
        near = keyed.select(*KEY, "words", F.posexplode(probes).alias("k", "hash")).join(_small(blocks, count * size), "hash")
        at, last = F.col("k") * step, F.size("words") - length
        starts = F.sequence(F.greatest(F.lit(0), at - step + 1), F.least(at, last))
        tried = near.select(*KEY, "words", F.explode(starts).alias("start"))
        tried = tried.select(*KEY, "start", F.slice("words", F.col("start") + 1, length).alias("gram"))
        matched = tried.join(_small(own, count), "gram").select(*KEY, "start", "length", "window")
        found = matched if found is None else found.unionByName(matched)
    if found is None:
        none = "start int, length int, window long"
        found = docs.sparkSession.createDataFrame([], f"{KEY[0]} long, {KEY[1]} long, {none}")
    return materialize(found.distinct(), "benchmark-hits"), members


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, extra: list[str] | None = None) -> DataFrame:
    """One row per document: n_words, n_hit, the items hit (ids as sorted texts) and word spans."""
    found, members = hits(docs, benchmark, size)
    end = F.col("start") + F.col("length")
    before = Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    longest = found.groupBy(*KEY, "start").agg(F.max("length").alias("length"))
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    spans = longest.select(*KEY, F.greatest("start", reached).alias("first"), end.alias("end")).filter("end > first")
    covered = spans.groupBy(*KEY).agg(
        F.sum(F.col("end") - F.col("first")).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"),
    )
    items = found.select(*KEY, "window").distinct().join(members, "window").select(*KEY, "item_id").distinct()
    items = items.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    per_doc = covered.join(items, KEY)
    count = F.size(words(lower_ascii(F.col("text")), WORD)).cast("long").alias("n_words")
    all_docs = with_key(docs, "doc_id", "text").select(*KEY, "doc_id", count, *(extra or []))
    joined = all_docs.join(per_doc, KEY, "left").drop(*KEY)
    return joined.withColumns(
        {"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))}
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Documents without any occurrence, with the input's columns."""
    found, _ = hits(docs, benchmark, size)
    clean = with_key(sealed(docs, "doc_id", "text"), "doc_id", "text").join(found.select(*KEY).distinct(), KEY, "left_anti")
    return unsealed(clean, docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """All documents, with the words of every occurrence and what separates them cut from the text."""
    found, _ = hits(docs, benchmark, size)
    spans = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "length")).alias("_spans"))
    joined = with_key(sealed(docs, "doc_id", "text"), "doc_id", "text").join(spans, KEY, "left")
    parts = F.split("text", ANY_CASE_WORD, -1)
    own = words(F.col("text"), ANY_CASE_WORD)
    cut = joined.withColumn("_parts", F.when(F.col("_spans").isNotNull(), parts))
    cut = cut.withColumn("_own", F.when(F.col("_spans").isNotNull(), own))
    places = F.filter(
        F.sequence(F.lit(0), F.size("_own") - 1),
        lambda i: ~F.exists("_spans", lambda s: i.between(s["start"], s["start"] + s["length"] - 1)),
    )
    kept = F.transform(places, lambda i: F.concat(F.get("_parts", i), F.get("_own", i)))
    text = F.concat(F.array_join(kept, ""), F.element_at("_parts", -1))
    return unsealed(cut, docs.columns, text=F.when(F.col("_spans").isNotNull(), text).otherwise(F.col("text")))
