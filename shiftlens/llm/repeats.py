"""Repeated byte strings: every byte covered by a ``SIZE``-byte string that starts twice.

Sorting every suffix of a corpus would move each byte hundreds of times, so only
anchored places are sorted. The anchor of a window of SIZE bytes is the place of its
least hashed GRAM-byte string; equal windows have their anchor at the same offset.
Windows that start next to each other share an anchor, which gives one row per anchor
with the range of their starts, about one row in 100 bytes.

Rows whose anchor string occurs once are done. Rows with equal contexts (all bytes of
their windows) are counted, not gathered: all their windows are repeated. They are told equal
by two hashes of 64 bits with different bases, one of the anchor string and one of the context. What is left
are the contexts at the edges of repeats. Their bytes are dealt by anchor string, and
in each task the suffixes that start at the anchors are sorted both ways, forward and
backward: a mergesort whose comparisons find the common extension by binary search on
prefix polynomial hashes. Two rows share the window at offset l before the anchor if
they agree on l bytes backward and SIZE - l forward, which neighbouring extensions in
the two orders tell. The bytes of what was found are compared, and another base is
taken after a collision. Anchor strings with more than HOT different contexts are not
gathered: their windows are hashed, counted with map-side sums and joined back.

Matches never cross documents. NULL is empty; texts shorter than SIZE keep all bytes.
Rows are told apart by (doc_id, text); a repeated row counts as another document.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.llm.native import KEY, sized, with_key
from shiftlens.session import materialize

SIZE, GRAM = 400, 200
SPAN = SIZE - GRAM + 1
BLOCK = 1 << 18
TEXTS = 500
HOT = 5000
TASK_BYTES = 2 << 20
BASES = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7]
PLACE_BITS = 24
ANCHOR = "_key_a long, _key_b long, gram long, context long, at long, first long, last long"
PART = "gram long, _key_a long, _key_b long, at long, first long, last long, single boolean, bytes binary"
FOUND = "_key_a long, _key_b long, first long, end long"


def _powers(base: int, size: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:
    """The first powers of ``base`` modulo 2**64, kept by the worker for the next block."""
    if len(known.get(base, ())) < size:
        power = np.full(size, base, np.uint64)
        power[0] = 1
        known[base] = np.multiply.accumulate(power, out=power)
    return known[base][:size]


class PrefixHash:
    """Polynomial hashes modulo 2**64 of all substrings of a buffer."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        self.back = _powers(pow(base, -1, 2**64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        ahead = self.sums[1:]
        np.add(data, np.uint64(1), out=ahead, dtype=np.uint64)
        np.multiply(ahead, _powers(base, n + 1)[:n], out=ahead)
        np.cumsum(ahead, out=ahead)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones, from minima of blocks both ways."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    rows = padded.reshape(-1, width)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead = np.minimum.accumulate(rows, axis=1, out=rows).ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(at, first, last, gram, context) of the windows that begin at ``starts`` (ascending places)."""
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none, none
    table = PrefixHash(data, BASES[0])
    grams = _mixed(table.of(np.arange(len(data) - GRAM + 1), GRAM))
    place = np.uint64((1 << PLACE_BITS) - 1)
    keyed = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_minimum(keyed, SPAN)[starts] & place).astype(np.int64)
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    first, last, at = starts[new], starts[np.append(new[1:], len(starts)) - 1], at[new]
    shape = ((at - first).astype(np.uint64) << np.uint64(16)) | (last - first).astype(np.uint64)
    context = _mixed(_mixed(PrefixHash(data, BASES[1]).of(first, last + SIZE - first)) ^ shape)
    return at, first, last, grams[at].view(np.int64), context.view(np.int64)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """One row per anchor of every text, places in bytes of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            blocks = [(k, s) for k, t in enumerate(texts) for s in range(0, max(len(t) - SIZE + 1, 0), BLOCK)]
            while blocks:
                taken, size = [], 0
                while blocks and size < BLOCK:
                    taken.append(blocks.pop(0))
                    size += min(BLOCK + SIZE - 1, len(texts[taken[-1][0]]) - taken[-1][1])
                parts = [texts[k][s : s + BLOCK + SIZE - 1] for k, s in taken]
                base = np.cumsum([0, *map(len, parts)])
                data = np.frombuffer(b"".join(parts), np.uint8)
                starts = np.concatenate([np.arange(b, b + len(p) - SIZE + 1) for b, p in zip(base, parts)])
                at, first, last, gram, context = anchors(data, starts)
                part = np.searchsorted(base, first, side="right") - 1
                shift = np.array([s for _, s in taken])[part] - base[part]
                row = pa.array(np.array([k for k, _ in taken])[part])
                columns = [batch[KEY[0]].take(row), batch[KEY[1]].take(row), gram, context, at + shift, first + shift, last + shift]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                    names=[*KEY, "gram", "context", "at", "first", "last"],
                )

    keyed = with_key(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", "text")
    return keyed.select("text", *KEY).mapInArrow(work, ANCHOR)


class AnchoredSuffixes:
    """Texts read from their anchors, forward or backward, in the order of their bytes."""

    def __init__(self, data: np.ndarray, table: PrefixHash, at: np.ndarray, sizes: np.ndarray, forward: bool):
        self.data, self.table, self.at, self.sizes, self.forward = data, table, at, sizes, forward

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search on hashes."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.sizes[a], self.sizes[b])
        while (low < high).any():
            middle = (low + high + 1) // 2
            x, y = (self.at[a], self.at[b]) if self.forward else (self.at[a] - middle, self.at[b] - middle)
            same = self.table.of(x, middle) == self.table.of(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        shared = self.common(a, b)
        end_a, end_b = shared >= self.sizes[a], shared >= self.sizes[b]
        last = len(self.data) - 1
        x, y = (self.at[a] + shared, self.at[b] + shared) if self.forward else (self.at[a] - 1 - shared, self.at[b] - 1 - shared)
        byte_a, byte_b = self.data[np.clip(x, 0, last)], self.data[np.clip(y, 0, last)]
        return np.where(end_a & end_b, or_equal, np.where(end_a, True, np.where(end_b, False, byte_a < byte_b)))

    def sorted(self, groups: np.ndarray) -> np.ndarray:
        """Mergesort inside ``groups`` (ascending numbers): each round places both runs by their ranks."""
        n = len(groups)
        order = np.arange(n)
        begin = np.searchsorted(groups, groups)
        size = np.searchsorted(groups, groups, side="right") - begin
        inside, width = np.arange(n) - begin, 1
        while width < size.max(initial=0):
            run = inside // width
            low = np.minimum((run ^ 1) * width, size) + begin
            high = np.minimum((run ^ 1) * width + width, size) + begin
            first, right = low.copy(), run % 2 == 1
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                middle = (low[live] + high[live]) // 2
                ahead = self.before(order[middle], order[live], right[live])
                low[live] = np.where(ahead, middle + 1, low[live])
                high[live] = np.where(ahead, high[live], middle)
            to = begin + (run // 2) * 2 * width + inside % width + (low - first)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, 2 * width
        return order


def shared_windows(
    data: np.ndarray, groups: np.ndarray, at: np.ndarray, back: np.ndarray, fewest: np.ndarray, base: int
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Largest and least offset of a repeated window before each anchor (-1: none), and whether bytes agree.

    ``back`` and ``fewest`` are the largest and least offsets of a row's windows.
    """
    table, n = PrefixHash(data, base), len(at)
    forward = AnchoredSuffixes(data, table, at, SIZE - fewest, True)
    backward = AnchoredSuffixes(data, table, at, back, False)
    cluster = []
    for suffixes in (forward, backward):
        order = suffixes.sorted(groups)
        common = np.concatenate([[-1], suffixes.common(order[:-1], order[1:])])
        common[1:][groups[order[1:]] != groups[order[:-1]]] = -1
        cluster.append((order, common))
    most, least = np.full(n, -1), np.full(n, -1)
    partner = np.full((2, n), -1)
    for offset in range(int(fewest.min(initial=0)), int(back.max(initial=-1)) + 1):
        rows = np.flatnonzero((fewest <= offset) & (offset <= back))
        ids = np.empty((2, n), np.int64)
        for k, need in enumerate((SIZE - offset, offset)):
            order, common = cluster[k]
            ids[k, order] = np.cumsum((common < need) | (common < 0))
        key = ids[0, rows] * (n + 1) + ids[1, rows]
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        same = key[1:] == key[:-1]
        hit = np.flatnonzero(np.append(same, False) | np.append(False, same))
        other = np.where(np.append(same, False)[hit], rows[np.minimum(hit + 1, len(rows) - 1)], rows[hit - 1])
        hits = rows[hit]
        most[hits], partner[0, hits] = offset, other
        new = least[hits] < 0
        least[hits[new]], partner[1, hits[new]] = offset, other[new]
    found = np.flatnonzero(most >= 0)
    agree = True
    for k, offset in enumerate((most, least)):
        for low in range(0, len(found), 4096):
            own = found[low : low + 4096]
            x = (at[own] - offset[own])[:, None] + np.arange(SIZE)
            y = (at[partner[k, own]] - offset[own])[:, None] + np.arange(SIZE)
            agree = agree and bool((data[x] == data[y]).all())
    return most, least, agree


def _edges(candidates: DataFrame, counts: DataFrame, docs: DataFrame) -> DataFrame:
    """One row with its bytes per different context of the anchor strings that have a context of one row."""
    one = candidates.groupBy("gram", "context").agg(F.min(F.struct(*KEY, "at", "first", "last")).alias("r"))
    mixed = counts.groupBy("gram").agg(F.min("n").alias("fewest"), F.count(F.lit(1)).alias("contexts"))
    mixed = materialize(mixed.filter("fewest = 1 AND contexts > 1").select("gram", "contexts"), "repeat-mixed")
    rows = one.join(counts, ["gram", "context"]).join(mixed, "gram")
    rows = rows.select("gram", "contexts", (F.col("n") == 1).alias("single"), "r.*")
    per_doc = materialize(
        rows.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "contexts", "single", "at", "first", "last")).alias("rows")), "repeat-edges"
    )
    keyed = with_key(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", "text")
    named = keyed.join(sized(per_doc, "rows"), KEY).select(*KEY, F.encode("text", "UTF-8").alias("data"), F.explode("rows").alias("r"))
    length = (F.col("r.last") - F.col("r.first") + SIZE).cast("int")
    cut = F.substring("data", (F.col("r.first") + 1).cast("int"), length)
    return materialize(named.select(*KEY, "r.*", cut.alias("bytes")), "repeat-contexts")


def _gathered(parts: DataFrame) -> DataFrame:
    """Spans found by suffix sorting inside groups of anchor strings of bounded bytes."""
    total = parts.agg(F.sum(F.octet_length("bytes").cast("long")).alias("n")).first()["n"] or 0
    tasks = -(-total // TASK_BYTES) or 1

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("gram")
        bodies = table["bytes"].to_pylist()
        data = np.frombuffer(b"".join(bodies), np.uint8)
        begin = np.cumsum([0, *map(len, bodies)])[:-1]
        at, first, last = (table[c].to_numpy() for c in ("at", "first", "last"))
        groups = np.unique(table["gram"].to_numpy(), return_inverse=True)[1]
        for base in BASES:
            most, least, agree = shared_windows(data, groups, begin + at - first, at - first, at - last, base)
            if agree:
                break
        else:
            raise RuntimeError("hash collisions under every base")
        keep = np.flatnonzero((most >= 0) & table["single"].to_numpy(zero_copy_only=False))
        columns = [table[k].take(pa.array(keep)) for k in KEY]
        spans = [pa.array((at - most)[keep]), pa.array((at - least)[keep] + SIZE)]
        return pa.table([*columns, *spans], names=[*KEY, "first", "end"])

    dealt = parts.select("gram", *KEY, "at", "first", "last", "single", "bytes")
    return dealt.groupBy(F.pmod(F.xxhash64("gram"), F.lit(tasks))).applyInArrow(work, FOUND)


def _hashed(parts: DataFrame) -> DataFrame:
    """Spans of anchor strings with very many contexts, by counting hashes of their windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                at, first, last = (row[c][0].as_py() for c in ("at", "first", "last"))
                data = np.frombuffer(row["bytes"][0].as_py(), np.uint8)
                starts = np.arange(last - first + 1)
                hashes = [_mixed(PrefixHash(data, b).of(starts, SIZE)).view(np.int64) for b in BASES[:2]]
                same = [pa.array([row[c][0].as_py()] * len(starts), pa.int64()) for c in KEY]
                single = pa.array([row["single"][0].as_py()] * len(starts))
                columns = [*same, pa.array(starts + first), single, *map(pa.array, hashes), pa.array(at - first - starts)]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "first", "single", "one", "two", "offset"])

    kind = "_key_a long, _key_b long, first long, single boolean, one long, two long, offset long"
    windows = materialize(parts.select(*KEY, "at", "first", "last", "single", "bytes").mapInArrow(work, kind), "repeat-windows")
    often = windows.groupBy("one", "two", "offset").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = windows.filter("single").join(often, ["one", "two", "offset"])
    return found.select(*KEY, "first", (F.col("first") + SIZE).alias("end"))


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, spans): the maximal repeated runs of each text that has one, places in bytes."""
    rows = materialize(anchor_rows(docs), "repeat-anchors")
    # Written, so that a join with a very frequent anchor string can be split.
    shared = materialize(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "repeat-grams")
    candidates = materialize(rows.join(shared, "gram"), "repeat-candidates")
    counts = materialize(candidates.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n")), "repeat-counts")
    whole = candidates.join(counts.filter("n > 1"), ["gram", "context"])
    found = whole.select(*KEY, "first", (F.col("last") + SIZE).alias("end"))
    parts = _edges(candidates, counts, docs)
    found = found.unionByName(_gathered(parts.filter(F.col("contexts") <= hot)))
    found = found.unionByName(_hashed(parts.filter(F.col("contexts") > hot)))
    before = Window.partitionBy(*KEY).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEY).orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    furthest = found.groupBy(*KEY, "first").agg(F.max("end").alias("end"))
    opened = furthest.withColumn("new", (F.col("first") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    runs = opened.withColumn("run", F.sum("new").over(upto)).groupBy(*KEY, "run")
    runs = runs.agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return materialize(runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans")), "repeat-spans")


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, the spans taken out, and the remaining bytes."""
    spans = repeated_spans(docs, hot)
    keyed = with_key(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", "text")
    joined = keyed.join(sized(spans, "spans"), KEY, "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cut in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                data, at, kept = (text or "").encode(), 0, []
                for s in cut or []:
                    kept.append(data[at : s["first"]])
                    at = s["end"]
                body = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(body), len(cut or []), body, hashlib.sha256(body).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return joined.select("doc_id", "text", "spans").mapInArrow(work, kind)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
