"""Packing: documents as pieces of token ids in windows of fixed size, best fit first.

Each document is encoded, ended with ``end_id`` and cut into full windows and a
rest. Pieces are dealt by a hash of their content into groups of bounded bytes; in
each group they are placed longest first into the open window with the least room
that still fits, found by a segment tree over the remaining room. Only a few windows
per group stay partly empty. A NULL text is empty (one end id), repeated rows are
packed as often as they occur, an empty table gives no row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.encoding import encoder
from shiftlens.llm.token_files import BATCH, text_bytes

WINDOW = 2048
GROUP_BYTES = 6 << 20
PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"
PLACED = f"{PIECE}, sequence_id long, offset long"


class OpenWindows:
    """Open windows by room left; the tree counts them below each node."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, window_id: int, room: int) -> None:
        self.by_room[room].append(window_id)
        self._count(room, 1)

    def _count(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += change
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Window with the least room of at least ``need``, and that room."""
        node = need + self.leaves
        while not self.tree[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return self.by_room[room].pop(), room


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; ``lengths`` must not increase."""
    opened, count, places, offsets = OpenWindows(window), 0, [], []
    for length in lengths:
        found = opened.take_tightest(length)
        if found is None:
            found, count = (count, window), count + 1
        place, room = found
        places.append(place)
        offsets.append(window - room)
        if room > length:
            opened.add(place, room - length)
    return places, offsets


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Documents cut into full windows and a rest; ids as little-endian unsigned 32-bit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                flat, sizes = encoder(tokenizer).encode(batch["text"], end_id)
                number = -(-sizes // window)
                row = np.repeat(np.arange(len(sizes)), number)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * window
                length = np.minimum(window, sizes[row] - start)
                offsets = np.concatenate([[0], np.cumsum(length)]) * 4
                ids = pa.BinaryArray.from_buffers(
                    pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.astype("<u4"))]
                )
                columns = [batch["doc_id"].take(pa.array(row)), *map(pa.array, (start, length, sizes[row])), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """Every piece with its ids, the window that it lies in and its offset there."""
    groups = -(-text_bytes(docs) // group_bytes) or 1

    def place(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lengths = table["length"].to_numpy()
        doc_ids = table["doc_id"].fill_null(-1).to_numpy()
        order = np.lexsort((table["start"].to_numpy(), doc_ids, -lengths))
        windows, offsets = best_fit(lengths[order].tolist(), window)
        first = key[0].as_py() << 32
        sequence = np.empty(len(order), np.int64)
        offset = np.empty(len(order), np.int64)
        sequence[order], offset[order] = np.array(windows, np.int64) + first, offsets
        table = table.drop_columns(["_group"])
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(groups)).alias("_group")
    cut = pieces(docs, tokenizer, window, end_id)
    return cut.select("*", group).groupBy("_group").applyInArrow(place, PLACED)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """One row per window: its ids in order, padded to ``window``, and the pieces in it."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum("length").alias("used"))
    ids = F.aggregate("parts", F.expr("X''"), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("used")).cast("int")))
    members = F.transform("parts", lambda p: p.dropFields("ids"))
    return parts.select("sequence_id", "used", members.alias("pieces"), F.concat(ids, pad).alias("ids"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
