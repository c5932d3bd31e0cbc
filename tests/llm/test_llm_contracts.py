"""The registered queries on the smallest tables against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import pytest

from shiftlens.llm import queries as q

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in q.documents(spark, SF_DIR).select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def encoded(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_path())
    return {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs}


def run(spark, name):
    return q.REGISTRY[name](spark, SF_DIR).collect()


def test_decontamination(spark, docs):
    items = [(r["item_id"], r["text"]) for r in q.benchmark(spark, SF_DIR).collect()]
    want = brute.decontamination(docs, items)
    assert sorted(tuple(r)[:6] for r in run(spark, "op1_decontamination")) == sorted(want)
    assert any(w[5] for w in want)


def test_sharding(spark, docs):
    rows = run(spark, "op3_sharding")
    texts = dict(docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_quality(spark, docs):
    texts = dict(docs)
    rows = run(spark, "op4_quality_rules")
    assert len(rows) == len(docs)
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute.quality(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_quality_follows_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    for r in run(spark, "op4_quality_rules"):
        if labels.get(r["doc_id"]) is not None:
            assert r["kept"] == (labels[r["doc_id"]] == 1 and not r["base_failed"])


def test_packing(spark, encoded):
    rows = run(spark, "op6_packing")
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        own = encoded[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(own) and r["ids_crc32"] == brute.crc(part)
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(encoded)
    for doc, parts in pieces.items():
        assert [s for s, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == len(encoded[doc])
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, encoded.values()))
    assert len(windows) <= 1.1 * total / 2048 + 1


def test_token_files(spark, encoded):
    start, want = 0, []
    for doc in sorted(encoded):
        want.append((doc, start, len(encoded[doc]), brute.crc(encoded[doc])))
        start += len(encoded[doc])
    assert sorted(map(tuple, run(spark, "op10_token_files"))) == want


def test_copies_of_texts_counted(docs):
    assert max(Counter(t for _, t in docs).values()) > 1


def test_near_duplicates(spark, docs):
    want = brute.near_duplicates(docs)
    assert sorted(map(tuple, run(spark, "op5_near_duplicates"))) == sorted(want)
    assert any(not kept for *_, kept in want)


def test_secrets(spark, docs):
    texts = dict(docs)
    rows = run(spark, "op7_secrets")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = brute.secrets(texts[r["doc_id"]])
        counts = Counter(k for k, *_ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(",")) | {""}


def test_repeats(spark, docs):
    want = [(d, *row) for (d, _), row in zip(docs, brute.repeats([t for _, t in docs]))]
    assert sorted(map(tuple, run(spark, "op8_repeats"))) == sorted(want)
    assert any(0 < r[2] < r[1] for r in want)


def test_repeats_of_very_frequent_strings(spark, docs):
    from shiftlens.llm import repeats

    rows = repeats.removed(q.documents(spark, SF_DIR), hot=1).drop("kept").collect()
    want = [(d, *row) for (d, _), row in zip(docs, brute.repeats([t for _, t in docs]))]
    assert sorted(map(tuple, rows)) == sorted(want)
