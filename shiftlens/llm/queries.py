"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import (
    chat, collocations, decontamination, licenses, near_duplicates, packing, quality, repeats, secrets, sharding, surrogates,
    token_files, whitening,
)
from shiftlens.session import new_table_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op10_token_files(spark, sf_dir):
    folder = new_table_path(spark, "tokens")
    return token_files.token_digest(spark, documents(spark, sf_dir), tokenizer_path(), folder)


@query
def op6_packing(spark, sf_dir):
    packed = packing.pack(documents(spark, sf_dir), tokenizer_path())
    crc = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@query
def op1_decontamination(spark, sf_dir):
    found = decontamination.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op4_quality_rules(spark, sf_dir):
    judged = quality.verdicts(documents(spark, sf_dir), quality.EXTRA).select("doc_id", "rejected_by", "features.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).drop("rejected_by")


@query
def op3_sharding(spark, sf_dir):
    placed = sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), 8)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_near_duplicates(spark, sf_dir):
    found = near_duplicates.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op7_secrets(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "format")
    counts = [of(kind) for kind in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


@query
def op8_repeats(spark, sf_dir):
    return repeats.removed(documents(spark, sf_dir)).drop("kept")


@query
def op9_surrogates(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return surrogates.replace(docs, "shiftlens", with_count="n_entities")


@query
def op2_licenses(spark, sf_dir):
    found = licenses.scan(documents(spark, sf_dir)).select("doc_id", "licenses")
    best = F.get("licenses", F.lit(0))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_matches"), best["name"].alias("license"),
        F.round(best["dice"], 6).alias("dice"), best["start"].cast("long").alias("start"), best["end"].cast("long").alias("end"),
    )


STREAMED = 512
CONTROL_CHAT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def chat_log(conversations: DataFrame) -> DataFrame:
    """Each row as the events that stream it: an opening and deltas of ``STREAMED`` characters.

    Rows of one turn follow by role and text; equal rows are messages of their own.
    """
    filled = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    tie = F.sha2(F.concat_ws("\x00", "role", "text"), 256)
    named = filled.withColumn("message", F.struct("turn", tie.alias("tie"), F.monotonically_increasing_id().alias("copy")))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STREAMED}}}"), F.lit(0))
    events = named.select("conv_id", "message", "role", F.posexplode(F.concat(F.array(F.lit("")), pieces)).alias("seq", "text"))
    return events.withColumn("kind", F.when(F.col("seq") == 0, "message").otherwise("delta"))


@query
def op13_chat_formatting(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(CONTROL_CHAT, "conv_id long, turn long, role string, text string")
    folder = new_table_path(spark, "chats")
    chat.write_chats(chat_log(rows.union(control)), folder)
    return chat.chat_digest(chat.read_chats(spark, folder))


@query
def op12_whitening(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(rows, whitening.fit_whitening(rows))


@query
def op11_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))
