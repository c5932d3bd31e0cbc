"""Secret scans: known forms by pattern, unknown ones by learned automata.

Credentials found by pattern are the labelled examples: a bounded number of them per
kind builds a prefix tree of character classes, whose states are merged while their
outgoing frequencies agree within the Hoeffding bound. The merged automaton gives the
probability of a string's format. Every other run of credential characters in every
text is scored under the automata and under a model of the corpus's ordinary runs; one
that is much likelier as a credential is added as kind ``format``.

A NULL or empty text has no spans. Equal rows get equal results. Without examples no
span is added.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.session import materialize

# Fixed values of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same matches as one or more, then 18 or more in all
HEX = r"[0-9a-f]{16,}"  # runs are maximal, so short ones can be left out at once
LEAST_VALUE = 12
KINDS = ["assign", "access", "hex", "format"]
CANDIDATE = r"[A-Za-z0-9+/_.=-]{16,}"
KEYWORDS = (b"passw", b"secret", b"token", b"api")

EXAMPLES = 2000
ALPHA = 0.05
BITS_PER_CHARACTER = 1.0
CLASSES = 7  # lower a-f, other lower, upper A-F, other upper, digit, mark, end
SPANS = "array<struct<start:int,kind:string,end:int>>"


def _class_table() -> np.ndarray:
    table = np.full(128, 5, np.int64)
    for k, members in enumerate(["abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789"]):
        for c in members:
            table[ord(c)] = k
    return table


def base_spans(text: str, assign: re.Pattern, access: re.Pattern, hexed: re.Pattern) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the known forms, by start and kind."""
    spans = []
    low = text.encode().lower()
    if any(k in low for k in KEYWORDS):
        for m in assign.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                spans.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m[0]) for m in access.finditer(text)]
    spans += [(m.start(), 2, m.end(), m[0]) for m in hexed.finditer(text)]
    return sorted(spans)


def _byte_classes() -> np.ndarray:
    """Class of each byte; bytes that no run holds count as its end."""
    table = np.full(256, CLASSES - 1, np.int64)
    for c in b"+/_.=-":
        table[c] = 5
    letters = _class_table()
    table[48:58], table[65:91], table[97:123] = letters[48:58], letters[65:91], letters[97:123]
    return table


def gathered(docs: DataFrame) -> DataFrame:
    """(kind, value, n): all different credentials, and how often each class follows each other one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
        table = _byte_classes()
        for batch in batches:
            texts = [t for t in batch["text"].to_pylist() if t]
            found = Counter((KINDS[k], v) for t in texts for _, k, _, v in base_spans(t, *patterns))
            classes = table[np.frombuffer(" ".join(["", *texts, ""]).encode(), np.uint8)]
            pairs = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=CLASSES**2).tolist()
            rows = [(*k, n) for k, n in sorted(found.items())] + [("pair", str(k), n) for k, n in enumerate(pairs)]
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "value", "n"])

    counted = docs.select("text").mapInArrow(work, "kind string, value string, n long")
    return materialize(counted.groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")


def labelled(found: DataFrame, examples: int = EXAMPLES) -> dict[str, list[str]]:
    """At most ``examples`` different credentials of each kind, those with the smallest hashes."""
    chosen = {}
    for kind in KINDS[:3]:
        own = found.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(examples)
        chosen[kind] = [r["value"] for r in own.collect()]
    return chosen


def ordinary_model(found: DataFrame) -> np.ndarray:
    """log2 probability of each class after each other one, in the runs of all texts."""
    counts = np.full(CLASSES**2, 0.5)
    for r in found.filter("kind = 'pair'").collect():
        counts[int(r["value"])] += r["n"]
    counts = counts.reshape(CLASSES, CLASSES)
    counts[CLASSES - 1, CLASSES - 1] = 0.5
    return np.log2(counts / counts.sum(axis=1, keepdims=True))


def merged_automaton(strings: list[str], alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(next state, log2 probability) by state and class, from the merged prefix tree."""
    table, end = _class_table(), CLASSES - 1
    children: list[dict[int, int]] = [{}]
    counts: list[Counter] = [Counter()]
    for s in sorted(strings):
        state = 0
        for c in table[np.frombuffer(s.encode(), np.uint8)].tolist():
            counts[state][c] += 1
            if c not in children[state]:
                children[state][c] = len(children)
                children.append({})
                counts.append(Counter())
            state = children[state][c]
        counts[state][end] += 1

    def differs(a: Counter, b: Counter) -> bool:
        n, m = sum(a.values()), sum(b.values())
        bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(a[c] / n - b[c] / m) > bound for c in {*a, *b})

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differs(counts[a], counts[b]):
                return False
            todo += [(children[a][c], children[b][c]) for c in children[a].keys() & children[b].keys()]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            counts[a] += counts[b]
            for c, below in children[b].items():
                if c in children[a]:
                    todo.append((children[a][c], below))
                else:
                    children[a][c] = below

    red, blue = [0], [(0, c) for c in sorted(children[0])]
    while blue:
        parent, c = blue.pop(0)
        state = children[parent][c]
        if state in red:
            continue
        target = next((r for r in red if compatible(r, state)), None)
        if target is None:
            red.append(state)
        else:
            children[parent][c] = target
            fold(target, state)
        blue = [(r, c) for r in red for c in sorted(children[r]) if children[r][c] not in red]
    place = {r: k for k, r in enumerate(red)}
    step = np.zeros((len(red) + 1, CLASSES), np.int64) + len(red)
    bits = np.full((len(red) + 1, CLASSES), -12.0)
    for r, k in place.items():
        total = sum(counts[r].values())
        for c, n in counts[r].items():
            bits[k, c] = math.log2((n + 0.01) / (total + 0.01 * CLASSES))
        for c, below in children[r].items():
            step[k, c] = place[below]
    return step, bits


def scores(runs: list[str], automata: list[tuple[np.ndarray, np.ndarray]], ordinary: np.ndarray) -> np.ndarray:
    """Bits per character by which the best automaton beats the ordinary model; all runs step together."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    classes = _class_table()[np.frombuffer("".join(runs).encode(), np.uint8)]
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes_down = sizes[order]
    best = np.full(len(runs), -np.inf)
    first = np.cumsum(sizes) - sizes
    before = np.concatenate([[CLASSES - 1], classes[:-1]])
    before[first] = CLASSES - 1
    plain = np.add.reduceat(ordinary[before, classes], first) + ordinary[classes[first + sizes - 1], CLASSES - 1]
    plain = plain[order]
    for step, bits in automata:
        state, total = np.zeros(len(runs), np.int64), np.zeros(len(runs))
        for at in range(int(sizes_down[0])):
            live = int(np.searchsorted(-sizes_down, -at, side="left"))
            c = classes[starts[:live] + at]
            total[:live] += bits[state[:live], c]
            state[:live] = step[state[:live], c]
        best = np.maximum(best, total + bits[state, CLASSES - 1] - plain)
    out = np.empty(len(runs))
    out[order] = best / sizes_down
    return out


def scan(docs: DataFrame, examples: int = EXAMPLES, least_bits: float = BITS_PER_CHARACTER) -> DataFrame:
    """(doc_id, spans): known forms and added ones by start, then kind as listed; code points, end exclusive."""
    found = gathered(docs)
    automata = [merged_automaton(values) for values in labelled(found, examples).values() if values]
    ordinary = ordinary_model(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
        candidate = re.compile(CANDIDATE)
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                texts = [t or "" for t in batch["text"].to_pylist()]
                spans = [[s[:3] for s in base_spans(t, *patterns)] for t in texts]
                runs = []
                for k, t in enumerate(texts) if automata else ():
                    for m in candidate.finditer(t):
                        if not any(s < m.end() and m.start() < e for s, _, e in spans[k]):
                            runs.append((k, m.start(), m.end(), m[0]))
                if runs:
                    for (k, start, end, _), bits in zip(runs, scores([r[3] for r in runs], automata, ordinary).tolist()):
                        if bits >= least_bits:
                            spans[k].append((start, 3, end))
                rows = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(own)] for own in spans]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, f"doc_id long, spans {SPANS}")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
