"""Wavelet matrix over token ids: bit planes with rank and select, and its file form.

Plane by plane, from the highest bit, the ids are put into a stable order with the
zeros of that bit first. A file holds the documents' ids and lengths and the planes,
each compressed; the rank directory (ones before each 64-bit word) is rebuilt on load.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle

MAGIC = b"WMX1"
HEADER = "<4sIII"
PLANE = "<II"


def _chosen(ids: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The ids whose bit of ``plane`` is set; Arrow reads such planes as they are."""
    mask = pa.Array.from_buffers(pa.bool_(), len(ids), [None, pa.py_buffer(plane)])
    return pa.array(ids).filter(mask).to_numpy()


class WaveletMatrix:
    def __init__(self, n: int, packed: list[np.ndarray], zeros: list[int]):
        self.n, self.packed, self.zeros = n, packed, zeros
        self._words: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        packed, zeros = [], []
        for b in range(bits - 1, -1, -1):
            plane = np.packbits(ids & ids.dtype.type(1 << b) != 0, bitorder="little")
            low, high = _chosen(ids, ~plane), _chosen(ids, plane)
            packed.append(plane)
            zeros.append(len(low))
            ids = np.concatenate([low, high])
        return cls(len(ids), packed, zeros)

    def ids(self) -> np.ndarray:
        """All ids in their order, by undoing the planes from the last to the first."""
        kind = np.uint16 if len(self.packed) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for b, (plane, zeros) in enumerate(zip(self.packed[::-1], self.zeros[::-1])):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            before = np.empty(self.n, kind)
            before[~ones] = ids[:zeros]
            before[ones] = ids[zeros:] | kind(1 << b)
            ids = before
        return ids

    def _directory(self) -> None:
        if self._words is None:
            size = self.n // 64 + 1
            self._words, self._before = [], []
            for plane in self.packed:
                word = np.zeros(size, "<u8")
                word.view(np.uint8)[: len(plane)] = plane
                self._words.append(word)
                self._before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)]))

    def _bit(self, k: int, i: np.ndarray) -> np.ndarray:
        return (self._words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def _rank1(self, k: int, i: np.ndarray) -> np.ndarray:
        part = self._words[k][i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self._before[k][i >> 6] + np.bitwise_count(part)

    def _select(self, k: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """Place of the nth (from 0) bit that is ``one``, by binary search on its rank."""
        low, high = np.zeros_like(nth), np.full_like(nth, self.n)
        while (low < high).any():
            middle = (low + high) // 2
            rank = self._rank1(k, middle + 1)
            enough = (rank if one else middle + 1 - rank) > nth
            high = np.where(enough & (low < high), middle, high)
            low = np.where(~enough & (low < high), middle + 1, low)
        return low

    def access(self, places) -> np.ndarray:
        """Ids at ``places``."""
        self._directory()
        i, value = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for k, zeros in enumerate(self.zeros):
            ones, rank = self._bit(k, i), self._rank1(k, i)
            i = np.where(ones, zeros + rank, i - rank)
            value = value * 2 + ones
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        self._directory()
        if value >> len(self.packed):
            return 0, 0
        ends = np.array([low, high], np.int64)
        for k, zeros in enumerate(self.zeros):
            rank = self._rank1(k, ends)
            ends = zeros + rank if value >> (len(self.packed) - 1 - k) & 1 else ends - rank
        return int(ends[0]), int(ends[1])

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """How often ``value`` stands in places ``low`` to ``high`` - 1."""
        first, last = self._range(value, low, self.n if high is None else high)
        return last - first

    def find(self, value: int) -> np.ndarray:
        """All places of ``value``, ascending."""
        first, last = self._range(value, 0, self.n)
        i = np.arange(first, last, dtype=np.int64)
        for k in range(len(self.packed) - 1, -1, -1):
            one = bool(value >> (len(self.packed) - 1 - k) & 1)
            i = self._select(k, i - self.zeros[k] if one else i, one)
        return i


def to_file(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """``known`` is false where a document has no id."""
    matrix, press = WaveletMatrix.build(ids), zstandard.ZstdCompressor(1)
    parts = [struct.pack(HEADER, MAGIC, matrix.n, len(doc_ids), len(matrix.packed))]
    parts += [doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), lengths.astype("<i8").tobytes()]
    for plane, zeros in zip(matrix.packed, matrix.zeros):
        body = press.compress(plane.tobytes())
        parts += [struct.pack(PLANE, zeros, len(body)), body]
    return b"".join(parts)


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    magic, n, docs, planes = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEADER)
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at + 8 * docs).astype(bool)
    lengths = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    packed, zeros, press = [], [], zstandard.ZstdDecompressor()
    for _ in range(planes):
        zero, size = struct.unpack_from(PLANE, data, at)
        at += struct.calcsize(PLANE)
        packed.append(np.frombuffer(press.decompress(data[at : at + size]), np.uint8))
        zeros.append(zero)
        at += size
    return doc_ids, known, lengths, WaveletMatrix(n, packed, zeros)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
