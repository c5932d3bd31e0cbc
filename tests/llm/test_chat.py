"""Event logs against a plain fold, rendering round trips, odd rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shiftlens.llm import chat
from shiftlens.llm import queries as q
from shiftlens.session import new_table_path

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, message long, seq long, kind string, role string, text string, part string, place int, cut string"


@pytest.fixture(scope="module", autouse=True)
def many_tasks(spark):
    """Small logs are cut over all tasks, too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def digest(conv, turns):
    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    shown = sum(len(chat.render(r, t)[0]) for r, t in turns)
    return (conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), shown)


def plain(events):
    """Replay in log order on a list of messages."""
    logs = {}
    for conv, message, seq, kind, role, text in events:
        logs.setdefault(conv, []).append((seq, message, kind, role, text))
    out = []
    for conv, log in logs.items():
        said = {}
        for _, message, kind, role, text in sorted(log, key=lambda e: e[0]):
            if kind == "regenerate":
                said = {m: v for m, v in said.items() if m < message}
            elif kind == "delta" and message in said:
                said[message][1] += text or ""
            else:
                old = said.get(message, [""])
                said[message] = [old[0] if kind == "edit" and role is None else role or "", text or ""]
        if said:
            out.append(digest(conv, [tuple(said[m]) for m in sorted(said)]))
    return out


def random_log(draw, convs, length):
    events = []
    for conv in range(convs):
        n = 0
        for seq in range(draw.randrange(1, length)):
            if not n or draw.random() < 0.3:
                events.append((conv, n, seq, "message", ("user", "assistant")[n % 2], f"m{seq} "))
                n += 1
                continue
            at = draw.randrange(n)
            kind = draw.choice(["delta", "delta", "edit", "regenerate"])
            events.append((conv, at, seq, kind, None, f"{kind[0]}{seq} "))
            if kind == "regenerate":
                n = at
    return events


def wide(spark, events):
    return spark.createDataFrame([(*e, "p", 1, "c") for e in events], SCHEMA).repartition(5)


def run(spark, events):
    folder = new_table_path(spark, "test-chats")
    chat.write_chats(wide(spark, events), folder)
    return sorted(map(tuple, chat.chat_digest(chat.read_chats(spark, folder)).collect()), key=str)


@pytest.mark.parametrize("seed,convs,length", [(1, 40, 30), (2, 1, 900), (3, 3, 300)])
def test_random_logs(spark, seed, convs, length):
    events = random_log(random.Random(seed), convs, length)
    assert run(spark, events) == sorted(plain(events), key=str)


def test_long_conversation_is_cut_over_tasks(spark):
    rows = [(5, m, m, "message", ("user", "assistant")[m % 2], f"text {m} ") for m in range(3000)]
    rows += [(5, 1500, 9000, "regenerate", None, None), (5, 1500, 9001, "message", "assistant", "again")]
    assert chat.messages(wide(spark, rows)).select("part").distinct().count() > 1
    assert run(spark, rows) == plain(rows)


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()] + q.CONTROL_CHAT
    turns = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: r[:2]):
        turns.setdefault(conv, []).append((role or "", text or ""))
    got = q.op13_chat_formatting(spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(digest(c, t) for c, t in turns.items())
    assert -7 in turns


def test_odd_rows(spark):
    assert run(spark, []) == []
    long = "long text </turn> \\ ### " * 60_000
    events = [
        (None, None, None, None, None, None), (None, 1, 2, "message", "assistant", long), (1, 0, 0, "delta", "user", "unopened"),
        (2, 0, 0, "message", "a: b\\", ""), (2, 0, 0, "message", "a: b\\", ""), (3, 0, 5, "message", "user", "gone"), (3, 0, 6, "regenerate", None, None),
    ]
    want = [
        digest(None, [("", ""), ("assistant", long)]), digest(1, [("user", "unopened")]), digest(2, [("a: b\\", "")]),
    ]
    assert run(spark, events) == sorted(want, key=str)


def test_rows_of_one_turn(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, None, None), (1, 0, "user", "a")]
    log = q.chat_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    folder = new_table_path(spark, "test-chats")
    chat.write_chats(log, folder)
    (got,) = chat.chat_digest(chat.read_chats(spark, folder)).collect()
    assert got["n_turns"] == 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(), st.one_of(st.text(), st.text(alphabet="\\#</turn>: \n")))))
def test_round_trip(turns):
    shown = [chat.render(r, t) for r, t in turns]
    assert list(chat.parse("".join(s for s, *_ in shown))) == turns
    assert all(chat.unescape(s[a:b]) == t for (s, a, b), (_, t) in zip(shown, turns))
