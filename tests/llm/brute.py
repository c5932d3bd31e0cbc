"""Plain one-machine versions of the contracts, for small inputs only."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def low(text):
    return (text or "").translate(ASCII_LOWER)


def decontamination(docs, items, size=10):
    """docs and items: lists of (id, text)."""
    grams = defaultdict(set)
    for item, text in items:
        w = WORD.findall(low(text))
        if w and item is not None:
            k = min(size, len(w))
            for i in range(len(w) - k + 1):
                grams[tuple(w[i : i + k])].add(item)
    lengths = {len(g) for g in grams}
    rows = []
    for doc, text in docs:
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                got = grams.get(tuple(w[i : i + k]))
                if got:
                    hit.update(range(i, i + k))
                    found |= got
        ids = ",".join(sorted(map(str, found)))
        rows.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return rows


def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(runs)
    repeated = {j for i, r in enumerate(runs) if often[r] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def shingles(text, size=5):
    w = SPACED.findall(low(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near_duplicates(docs):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows with different ids."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [(d, len(x), root(d), d == root(d)) for d, x in sets]


SECRETS = {
    "assign": re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    """(kind, start, end) by start, then kind as listed."""
    spans = []
    for order, (kind, pattern) in enumerate(SECRETS.items()):
        for m in pattern.finditer(text or ""):
            if kind == "assign" and len(m[2]) >= 12 or kind == "access" and len(m[0]) >= 18 or kind == "hex" and len(m[0]) >= 16:
                spans.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


def repeats(texts, size=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    rows = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        rows.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
