"""Conversations rebuilt from an event log and rendered with a loss mask.

An event has ``conv_id``, ``message`` (any ordered type: the place of the message in its
conversation), ``seq`` (its place in the log), ``kind``, ``role`` and ``text``:

* ``message`` opens a message, or opens it anew;
* ``delta`` appends a streamed piece;
* ``edit`` replaces what the message says, and its role if one is given;
* ``regenerate`` takes the message and all later ones away that were opened before it.

The log is partitioned by conversation and message ranges, sorted, and folded while it
streams by: a message is what its last opening and the deltas after it say, and it
stays if no ``regenerate`` of itself or an earlier message has a later ``seq`` than that
opening. The largest such ``seq`` so far is all that is carried from message to
message. A conversation may therefore be cut over many tasks; what the tasks before have to
tell is a number and a count for each task.

Rendering gives ``### role: text</turn>`` per message. Backslashes, ``###`` and ``</turn>``
inside texts, and colons inside roles, get a backslash in front, which ``parse`` takes away.
The loss mask lists the code point ranges of assistant texts. A row of output holds a
conversation, or at most about ``ROW_CHARS`` characters of one.

NULL texts and roles are empty, a NULL ``kind`` is ``message``, NULL ids are one conversation,
NULL places and numbers come first. Events that are equal in all else follow by kind, role
and text. Repeated ``message`` events of one place open it anew, so they count once. Other columns are not read.
An empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.session import materialize

ROW_CHARS = 1 << 20
BATCH_CHARS = 8 << 20
FIRST = -(2**63)
KINDS = ("message", "delta", "edit", "regenerate")
OPEN, CLOSE = "### ", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
ASSISTANT = "assistant"
SPANS = "array<struct<start: long, end: long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The message in the template, and where its text begins and ends in it."""
    head = f"{OPEN}{escape(role).replace(':', '\\:')}: "
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each message of a rendered row."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no message begins at {at}")
        yield unescape(found[1]), unescape(found[2])
        at = found.end()


class Fold:
    """The message that the events of one place make, and the latest cut of its conversation."""

    def __init__(self) -> None:
        self.cut: int | None = None
        self.begin()

    def begin(self) -> None:
        self.opened: int | None = None
        self.role, self.parts, self.cut_here = "", [], False

    def add(self, seq: int | None, kind: str | None, role: str | None, text: str | None) -> None:
        seq, kind = FIRST if seq is None else seq, kind or "message"
        if kind not in KINDS:
            raise ValueError(f"unknown event {kind!r}")
        if kind == "regenerate":
            cut = seq if self.cut is None else max(self.cut, seq)
            self.begin()
            self.cut, self.cut_here = cut, True
        elif kind == "delta" and self.opened is not None:
            self.parts.append(text or "")
        else:
            self.role = self.role if kind == "edit" and role is None else role or ""
            self.opened, self.parts = seq, [text or ""]

    def stays(self, cut: int | None) -> bool:
        return self.opened is not None and (cut is None or self.opened > cut)


def messages(events: DataFrame) -> DataFrame:
    """Folded log in ranges: (part, place, conv_id, opened, role, text, cut), written down.

    Rows without ``opened`` only tell of a cut. ``cut`` is the latest cut before the end
    of the message that the same part has seen in the conversation.
    """
    columns = ["conv_id", "message", "seq", "kind", "role", "text"]
    log = events.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "kind", "role", "text")
    ranged = log.repartitionByRange("conv_id", "message").sortWithinPartitions(*columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars, place, current, fold = [], 0, 0, None, Fold()

        def flush() -> None:
            nonlocal chars, place
            stays = fold.stays(fold.cut)
            if current is not None and (stays or fold.cut_here):
                text = "".join(fold.parts) if stays else None
                rows.append((place, current[0], fold.opened if stays else None, fold.role if stays else None, text, fold.cut))
                chars, place = chars + len(text or "") + 64, place + 1

        def batch_of(kinds: list[pa.DataType]) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["place", "conv_id", "opened", "role", "text", "cut"])

        for batch in batches:
            kinds = [pa.int64(), batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.int64()]
            for conv, message, *event in zip(*(batch[c].to_pylist() for c in columns)):
                if current is None or current != (conv, message):
                    flush()
                    fold.begin()
                    if current is None or current[0] != conv:
                        fold.cut = None
                    current = (conv, message)
                fold.add(*event)
                if chars > BATCH_CHARS:
                    yield batch_of(kinds)
                    rows, chars = [], 0
        flush()
        if rows:
            yield batch_of(kinds)

    conv = log.schema["conv_id"].dataType.simpleString()
    folded = ranged.mapInArrow(work, f"place long, conv_id {conv}, opened long, role string, text string, cut long")
    return materialize(folded.withColumn("part", F.spark_partition_id()), "chat-messages")


def _carried(folded: DataFrame) -> dict[int, int | None]:
    """Per part the latest cut that earlier parts hold of the conversation it begins with; a row per part."""
    edge = folded.groupBy("part").agg(
        F.min_by(F.struct("conv_id"), "place").alias("first"), F.max_by(F.struct("conv_id", "cut"), "place").alias("last")
    )
    carried, before, cut = {}, None, None
    for row in sorted(edge.collect(), key=lambda r: r["part"]):
        first, (last, latest) = row["first"], row["last"]
        known = cut if before == (first["conv_id"],) else None
        carried[row["part"]] = known
        same = first["conv_id"] == last
        cut = max((c for c in (latest, known if same else None) if c is not None), default=None)
        before = (last,)
    return carried


def write_chats(events: DataFrame, folder: str) -> None:
    """Render the log as Parquet rows (conv_id, part, place, formatted, loss) in ``folder``."""
    folded = messages(events)
    carried = _carried(folded)
    conv = folded.schema["conv_id"].dataType.simpleString()
    live = folded.filter(F.col("opened").isNotNull())

    def work(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table:
            rows, current, pieces, spans, chars, begun = [], None, [], [], 0, 0

            def flush() -> None:
                if pieces:
                    rows.append((current[1], current[0], begun, "".join(pieces), list(spans)))

            columns = [batch[c].to_pylist() for c in ("conv_id", "part", "place", "opened", "role", "text", "carried")]
            for conv_id, part, place, opened, role, text, cut in zip(*columns):
                if cut is not None and opened <= cut:
                    continue
                if current != (part, conv_id) or chars > ROW_CHARS:
                    flush()
                    current, pieces, spans, chars, begun = (part, conv_id), [], [], 0, place
                shown, start, end = render(role, text)
                if role == ASSISTANT:
                    spans.append({"start": chars + start, "end": chars + end})
                pieces.append(shown)
                chars += len(shown)
            flush()
            kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.large_string()]
            kinds.append(pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "place", "formatted", "loss"])

    spark = events.sparkSession
    first = [(p, c) for p, c in carried.items() if c is not None]
    if first:
        edges = F.broadcast(spark.createDataFrame(first, "part int, _cut long"))
        begins = folded.groupBy("part").agg(F.min_by(F.struct("conv_id"), "place").alias("_first"))
        known = F.broadcast(edges.join(begins, "part"))
        live = live.join(known, "part", "left")
        own = F.struct("conv_id").eqNullSafe(F.col("_first"))
        live = live.withColumn("carried", F.when(own, F.col("_cut"))).drop("_cut", "_first")
    else:
        live = live.withColumn("carried", F.lit(None).cast("long"))
    kind = f"conv_id {conv}, part int, place long, formatted string, loss {SPANS}"
    live.select("conv_id", "part", "place", "opened", "role", "text", "carried").mapInArrow(work, kind).write.parquet(folder)


def read_chats(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def chat_digest(chats: DataFrame) -> DataFrame:
    """Per conversation what its rendered rows say, read again from them.

    SHA-256 of a whole conversation can only be taken in order, so each conversation
    streams through one task; that task holds one row at a time.
    """
    conv = chats.schema["conv_id"].dataType.simpleString()
    dealt = chats.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def out(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([current[0]], kind)]
            columns += [pa.array([v.hexdigest() if hasattr(v, "hexdigest") else v]) for v in state]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, formatted, loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if current != (conv_id,):
                    if current is not None:
                        yield out(kind)
                    current, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
        if current is not None:
            yield out(kind)

    kind = f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(work, kind)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
