"""Near-duplicates: b-bit MinHash signatures and a multi-index Hamming join.

A text is the set of its 5-word shingles. ``CHUNKS`` chunks of ``CHUNK`` slots of 16
bits form a signature. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1
slots have, by pigeonhole, a chunk with at most ERRORS different slots, so every chunk
is looked up under each choice of ERRORS slots left out: all such pairs meet in a
bucket. Links are confirmed on full shingle sets.

Groups are contracted while they are linked. Equal sets are one node. In a few
rounds each bucket proposes one of its nodes as a centre to all the others, which is
linear in its size; nodes that are connected by then are not compared again. At last all
pairs from different components that share a bucket are tried, so nothing is capped:
shingles that no other open node has bound what a node can share, which spares most
nodes; the others are compared block by block, by a product of incidence matrices over
their shingles, and only links leave a task, one per two components of a block.

NULL, empty and blank texts have no shingles and link with nothing. Texts with fewer
than five words have one shingle, all their words. Equal rows are equal copies.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.components import components
from shiftlens.llm.native import KEY, SPACED_WORD, sealed, unsealed, with_key
from shiftlens.session import materialize

SHINGLE = 5
CHUNKS, CHUNK, ERRORS = 12, 4, 1
SLOTS = CHUNKS * CHUNK
LEAST_MATCHES = 21
CENTRE_ROUNDS = 3
BROADCAST_ROWS = 500_000
BLOCK_NODES, BLOCK_SHINGLES = 1024, 300_000
SHINGLES_AT_ONCE = 4096
MOST_WORDS = 1_000_000
SKETCH = "doc_id long, _key_a long, _key_b long, n_shingles long, digest binary, signature binary"


def _odd(seed: int, count: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordIds(dict):
    """64-bit hash of each word, kept for the words met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(text: str | None, ids: WordIds, factors: np.ndarray) -> np.ndarray:
    """One hash per 5-word window; ``bytes`` lower and split at exactly the ASCII letters and spaces wanted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += (w[k : k + n] ^ factors[SHINGLE + k]) * factors[k]
    return _mixed(total)


def sketch(docs: DataFrame) -> DataFrame:
    """Set size, digest of the set and signature per row; NULL digest for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, factors = WordIds(), _odd(5, 2 * SHINGLE)
        flip, turn = _odd(7, SLOTS), _odd(11, SLOTS)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                hashes = [shingle_hashes(t.as_py(), ids, factors) for t in batch["text"]]
                sets = [np.unique(h) for h in hashes]
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                signature = np.zeros((len(sets), SLOTS), "<u2")
                if len(full):
                    every = np.concatenate([sets[k] for k in full])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    for j in range(SLOTS):
                        least = np.minimum.reduceat(_mixed(every ^ flip[j]) * turn[j], starts)
                        signature[full, j] = (least ^ (least >> np.uint64(29))) & np.uint64(0xFFFF)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"], batch[KEY[0]], batch[KEY[1]], pa.array(sizes),
                        pa.array(digest, pa.binary()), pa.array([s.tobytes() for s in signature], pa.binary()),
                    ],
                    names=["doc_id", *KEY, "n_shingles", "digest", "signature"],
                )

    keyed = with_key(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", "text")
    return keyed.select("doc_id", "text", *KEY).mapInArrow(work, SKETCH)


def nodes_of(sketched: DataFrame) -> DataFrame:
    """One row per different set, with one of its documents; written, so that ``node`` stays."""
    own = sketched.filter(F.col("digest").isNotNull())
    sets = own.groupBy("digest", "n_shingles", "signature").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct(*KEY)).alias("_row")
    )
    return materialize(
        sets.select(
            F.monotonically_increasing_id().alias("node"), "digest", F.col("n_shingles").alias("n"), "signature", "doc_id",
            *(F.col(f"_row.{k}").alias(k) for k in KEY),
        ),
        "near-nodes",
    )


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(bucket, node): each chunk under each choice of ``ERRORS`` slots left out."""
    kept = list(combinations(range(CHUNK), CHUNK - ERRORS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            slots = np.frombuffer(b"".join(batch["signature"].to_pylist()), "<u2").reshape(count, SLOTS).astype(np.uint64)
            buckets = np.zeros((count, CHUNKS * len(kept)), np.uint64)
            for v in range(CHUNKS * len(kept)):
                chunk, left = divmod(v, len(kept))
                value = np.full(count, v, np.uint64)
                for place in kept[left]:
                    value = (value << np.uint64(16)) | slots[:, chunk * CHUNK + place]
                buckets[:, v] = value
            columns = [pa.array(buckets.ravel().view(np.int64)), batch["node"].take(pa.array(np.repeat(np.arange(count), buckets.shape[1])))]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "node"])

    return nodes.select("node", "signature").mapInArrow(work, "bucket long, node long")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree in ``LEAST_MATCHES`` slots.

    A pair with a similarity of 0.75 agrees in 36 of 48 slots on average and in fewer
    than 21 with probability 2e-6.
    """
    side = nodes.select("node", "n", "signature")
    a, b = (side.select(*(F.col(c).alias(f"{c}_{s}") for c in side.columns)) for s in "ab")
    sized = pairs.join(a, pairs["a"] == a["node_a"]).join(b, pairs["b"] == b["node_b"])
    sized = sized.filter(4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("signature_a", "signature_b"))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= LEAST_MATCHES)).select(["a", "b"])

    return sized.select("a", "b", "signature_a", "signature_b").mapInArrow(agree, "a long, b long")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 75 * union on full sets, from the texts of their nodes."""
    pairs = materialize(likely(pairs, nodes), "likely-pairs")
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _texts(used, nodes, docs)
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, factors = WordIds(), _odd(5, 2 * SHINGLE)
        for batch in batches:
            linked, last, mine = [], None, None
            for left, x, y in zip(batch["a"].to_pylist(), batch["text_a"], batch["text_b"]):
                if left != last:
                    last, mine = left, np.unique(shingle_hashes(x.as_py(), ids, factors))
                other = np.unique(shingle_hashes(y.as_py(), ids, factors))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                linked.append(100 * both >= 75 * (len(mine) + len(other) - both))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    return materialize(pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"), "near-links")


def _with_component(members: DataFrame, labels: DataFrame) -> DataFrame:
    named = members.select("bucket", "node").join(labels, "node", "left")
    return named.withColumn("component", F.coalesce("component", "node"))


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component."""
    mixed = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
    return members.join(mixed.select("bucket"), "bucket")


def _last_links(unlinked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different components that share a bucket, one per two components of a block.

    A bucket is cut into blocks of bounded bytes, and two blocks meet in one run of rows.
    """
    bounded = _bounds(unlinked, nodes, docs)
    sub = unlinked.join(bounded.select("node", "n", "slack"), "node")
    least = sub.groupBy("bucket").agg(F.min("n").alias("least"))
    sub = materialize(sub.join(least, "bucket").filter("slack >= 3 * least").drop("least", "slack"), "near-bounded")
    sub = materialize(_open(sub), "near-last")
    many = F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)
    blocks = sub.groupBy("bucket").agg(F.ceil(many).cast("int").alias("blocks"))
    placed = sub.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("bucket", "node", "component", "n", "block", other)
    placed = placed.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("other")
    run = ["bucket", "p", "q"]
    rows = placed.join(bounded.select("node", "own"), "node").repartition(*run).sortWithinPartitions(*run, "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, run):
            n, component = (group[c].to_numpy() for c in ("n", "component"))
            across = group["p"][0].as_py() != group["q"][0].as_py()
            second = (group["block"].to_numpy() == group["q"][0].as_py()) if across else None
            left, right = _linked(group["own"].combine_chunks(), n, component, second)
            node = group["node"].to_numpy()
            x, y = node[left], node[right]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    columns = rows.select(*run, "node", "component", "n", "block", "own")
    return materialize(columns.mapInArrow(work, "a long, b long").distinct(), "near-links")


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows that follow each other and agree in ``by``, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in by], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)] if len(keys) else []
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            key = tuple(keys[start])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _linked(own: pa.ListArray, n: np.ndarray, component: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows, one link per two components; with ``second`` only across both sides.

    Intersections are a product of incidence matrices, taken some shingles at a time.
    """
    left, right = (np.arange(len(n)),) * 2 if second is None else (np.flatnonzero(~second), np.flatnonzero(second))
    sizes = np.diff(own.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), sizes)
    _, code, count = np.unique(own.flatten().to_numpy(), return_inverse=True, return_counts=True)
    often = count[code] > 1
    row, code = row[often], code[often]
    reach = 7 * np.bincount(row, minlength=len(n)) - 3 * n >= 3 * n.min()
    left, right = left[reach[left]], right[reach[right]]
    if not len(left) or not len(right):
        return left[:0], right[:0]
    order = np.argsort(code, kind="stable")
    row, code = row[order], np.cumsum(np.diff(code[order], prepend=code[order][:1]) != 0)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(code[-1]) + 1, SHINGLES_AT_ONCE):
        start, end = np.searchsorted(code, [at, at + SHINGLES_AT_ONCE])
        has = np.zeros((len(n), int(code[end - 1]) + 1 - at), np.float32)
        has[row[start:end], code[start:end] - at] = 1
        both += has[left] @ has[right].T
    x, y = np.nonzero((7 * both >= 3 * (n[left][:, None] + n[right])) & (component[left][:, None] != component[right]))
    left, right = left[x], right[y]
    two = np.sort(np.stack([component[left], component[right]], axis=1), axis=1)
    first = np.unique(two, axis=0, return_index=True)[1]
    return left[first], right[first]


def _bounds(sub: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, n, own, slack): the shingles that a node shares with any other node of ``sub``.

    With s such shingles the intersection with y is at most s, and a similarity of 0.75
    needs 7 * intersection >= 3 * (n + n_y). So it needs slack = 7 * s - 3 * n >= 3 * n_y.
    """
    sets = _texts(sub.select("node").distinct(), nodes, docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, factors = WordIds(), _odd(5, 2 * SHINGLE)
        for batch in batches:
            own = [np.unique(shingle_hashes(t.as_py(), ids, factors)).view(np.int64) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])

    single = sets.mapInArrow(work, "node long, own array<long>").select("node", F.explode("own").alias("shingle"))
    single = materialize(single, "near-shingles")
    often = single.groupBy("shingle").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x != y").select("shingle")
    shared = single.join(often, "shingle").groupBy("node").agg(F.collect_list("shingle").alias("own"))
    slack = (7 * F.size("own") - 3 * F.col("n")).alias("slack")
    return materialize(nodes.select("node", "n").join(shared, "node").select("node", "n", "own", slack), "near-bounds")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) for the wanted nodes."""
    used = materialize(wanted.join(nodes, "node").select("node", *KEY), "near-wanted")
    keyed = with_key(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", "text")
    small = F.broadcast(used) if used.count() <= BROADCAST_ROWS else used
    return materialize(keyed.join(small, KEY).select("node", "text"), "near-texts")


def link_groups(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have a link."""
    spark = nodes.sparkSession
    keys = bucket_keys(nodes)
    shared = keys.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x != y")
    members = materialize(keys.join(shared.select("bucket"), "bucket"), "near-members")
    links = tried = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, component long")
    for turn in range(CENTRE_ROUNDS + 1):
        unlinked = materialize(_open(_with_component(members, labels)), "near-open")
        if unlinked.isEmpty():
            break
        if turn < CENTRE_ROUNDS:
            order = F.struct(F.xxhash64("node", F.lit(turn)), "node", "component")
            centres = unlinked.groupBy("bucket").agg(F.min(order).alias("c"))
            centres = centres.select("bucket", F.col("c.node").alias("centre"), F.col("c.component").alias("own"))
            centres = materialize(centres, "near-centres")
            pairs = unlinked.join(centres, "bucket").filter("own != component").select("node", F.col("centre").alias("other"))
            pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
            pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
            tried = tried.unionByName(pairs)
            found = confirmed(pairs, nodes, docs)
        else:
            found = _last_links(unlinked, nodes, docs)
        links = links.unionByName(found)
        if not found.isEmpty():
            labels = components(links)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept.

    A row without a doc_id is kept only if no document of its group has one.
    """
    sketched = materialize(sketch(docs), "near-sketch")
    nodes = nodes_of(sketched)
    labels = link_groups(nodes, docs)
    named = nodes.select("node", "digest", "doc_id").join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(smallest, "component").select("digest", "component", "component_id")
    rows = sketched.select("doc_id", "n_shingles", "digest", *KEY).join(by_set, "digest", "left")
    rows = rows.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("digest")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with the input's columns; rows without shingles all stay.

    Of rows that repeat the kept ``doc_id`` within a group one stays.
    """
    rows = near_duplicates(docs)
    first = rows.filter("kept").withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")))
    chosen = first.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(*KEY)).alias("_row"))
    chosen = chosen.select("_row.*").unionByName(first.filter("component IS NULL").select(*KEY).distinct())
    kept = with_key(sealed(docs, "doc_id", "text"), "doc_id", "text").join(chosen, KEY, "left_semi")
    blank = ~F.coalesce("text", F.lit("")).rlike(SPACED_WORD)
    repeated = kept.filter(~blank).dropDuplicates(KEY).unionByName(kept.filter(blank))
    return unsealed(repeated, docs.columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
