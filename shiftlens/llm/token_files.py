"""Token files: all documents in ascending ``doc_id`` order, one wavelet matrix per file.

A NULL text has only the end id; documents without a ``doc_id`` come first, equal
ids are ordered by text. An empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlens.llm.encoding import encoder
from shiftlens.llm.wavelet import from_file, to_file
from shiftlens.session import materialize

SHARD_BYTES = 16 << 20
FILE_IDS = 4 << 20
BATCH = 1000
MANIFEST = "part int, number int, file string, n_docs long, n_ids long"
DOCUMENTS = "file string, doc_id long, local_start long, n_tokens long, ids binary"


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts and one per row."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("n"))
    return total.first()["n"] or 0


def _write(folder: str, name: str, data: bytes) -> None:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/.{name}.tmp") as out:
        out.write(data)
    store.move(f"{path}/.{name}.tmp", f"{path}/{name}")


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Encode, sort by range and write the files; returns one row per file.

    Ranges are cut at (doc_id, hash of the text), so that one id with many texts is
    split. A task holds one file's ids; a file ends after the document that fills it.
    Names follow the order, so a task that runs again writes the same files.
    """
    shards = -(-text_bytes(docs) // shard_bytes) or 1
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, *order)
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, held = None, 0, []

        def flush() -> pa.RecordBatch:
            doc_ids, known, lengths, ids = (np.concatenate(x) for x in zip(*held))
            name = f"tokens-{part:06d}-{number:04d}.wm"
            _write(folder, name, to_file(doc_ids, known, lengths, ids))
            columns = ([part], [number], [name], [len(doc_ids)], [len(ids)])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["part", "number", "file", "n_docs", "n_ids"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                coder, part = coder or encoder(tokenizer), batch["part"][0].as_py()
                ids, lengths = coder.encode(batch["text"], end_id)
                known = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
                held.append((batch["doc_id"].fill_null(0).to_numpy(), known, lengths, ids))
                if sum(len(x[3]) for x in held) >= FILE_IDS:
                    yield flush()
                    held, number = [], number + 1
        if held:
            yield flush()

    return materialize(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(write, MANIFEST), "token-files")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of the files: place in the file and ids as little-endian unsigned 32-bit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                doc_ids, known, lengths, matrix = from_file(content.as_py())
                flat = matrix.ids().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                for at in range(0, len(doc_ids), BATCH):
                    own = slice(at, at + BATCH)
                    first, last = starts[own][0], ends[own][-1]
                    offsets = np.concatenate([starts[own], [last]]) - first
                    ids = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(offsets) - 1,
                        [None, pa.py_buffer((4 * offsets).astype(np.int64)), pa.py_buffer(flat[first:last])],
                    ).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.as_py()] * len(ids)),
                            pa.array(doc_ids[own], mask=~known[own]),
                            pa.array(starts[own]),
                            pa.array(lengths[own]),
                            ids,
                        ],
                        names=["file", "doc_id", "local_start", "n_tokens", "ids"],
                    )

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.mapInArrow(read, DOCUMENTS)


def file_offsets(manifest: DataFrame) -> DataFrame:
    """Ids in all earlier files; one row per file, so a large corpus wants large files."""
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("file", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("earlier"))


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(file, place) of every occurrence of ``token``, by select on the bit planes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                places = from_file(content.as_py())[3].find(token)
                names = pa.array([file.as_py()] * len(places), pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(places)], names=["file", "place"])

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.mapInArrow(find, "file string, place long")


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write the files, read them back: one row per document with its place among all ids."""
    manifest = write_token_files(docs, tokenizer, folder)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read_documents(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return rows.join(file_offsets(manifest), "file").select(
        "doc_id", (F.col("earlier") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
