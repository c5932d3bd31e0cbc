"""Quality rules as a cascade: cheap rules that reject much come first.

On a bounded sample (``sample_rows``) each rule is run alone, twice; the shorter time, less
that of a job which only cuts the words, and the share of rejected documents give
rejection per cost, and the rules are put in that order.
One conditional column then stops at the first rule that rejects. A document is kept
if no rule rejects, so the order never changes the verdict.

A NULL text has no words; it and empty texts are rejected as too short.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.native import SPACED_WORD, let, words
from shiftlens.session import materialize

SAMPLE_ROWS = 1000
SEED = 11
LEAST_COST = 0.001  # seconds; below it times are noise
RUN = 3


def n_words(text: Column, w: Column) -> Column:
    return F.size(w)


def word_chars(text: Column, w: Column) -> Column:
    return F.char_length(F.array_join(w, ""))


def n_symbols(text: Column, w: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]"))


def _lines(text: Column, w: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(SPACED_WORD))


def n_dup_lines(text: Column, w: Column) -> Column:
    return let(_lines(text, w), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def _repeated_places(runs: Column) -> Column:
    """Places of runs whose hash occurs twice, ascending: sort by hash, compare neighbours."""
    ordered = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        same = F.transform(
            s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])
        )
        return F.array_sort(F.array_compact(same))

    return let(ordered, twins)


def n_repeat_words(text: Column, w: Column) -> Column:
    """Words inside runs of three words that occur at least twice in the text."""
    places = F.sequence(F.lit(0), F.size(w) - RUN)
    hashed = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(runs: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-RUN).alias("last"))
        total = F.aggregate(
            _repeated_places(runs),
            start,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(RUN), i - acc["last"])).alias("n"), i.alias("last")),
        )
        return F.when(F.size(F.array_distinct(runs)) < F.size(runs), total["n"]).otherwise(0)

    return F.when(F.size(w) <= RUN, 0).otherwise(let(hashed, covered))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Column, Column], Column]


TOO_SHORT = Rule("too_short", lambda t, w: n_words(t, w) < 50)
REPETITIVE = Rule("repetitive", lambda t, w: 100 * n_repeat_words(t, w) > 50 * n_words(t, w))
BASE = [TOO_SHORT, REPETITIVE]
EXTRA = [
    Rule("symbols", lambda t, w: 10 * n_symbols(t, w) > n_words(t, w)),
    Rule("capitals", lambda t, w: 10 * F.regexp_count(t, F.lit(r"\p{Lu}{3,}")) > 3 * n_words(t, w)),
    Rule("repeated_lines", lambda t, w: 2 * n_dup_lines(t, w) > F.size(_lines(t, w))),
    Rule("word_length", lambda t, w: ~(word_chars(t, w) / F.greatest(n_words(t, w), F.lit(1))).between(2, 12)),
]


def of_text(body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the text and its words, which are found once per row.

    They are bound as a lambda variable, as the optimizer would copy a column's
    expression to each place that a filter names it.
    """
    return let(F.coalesce("text", F.lit("")), lambda t: let(words(t, SPACED_WORD), lambda w: body(t, w)))


def ordered_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected share per second on a sample; only their order depends on it.

    Rows are drawn by a share that expects twice the wanted number over all partitions,
    so that few more than that reach the task which cuts the sample to size.
    """
    share = min(1.0, 2.0 * sample_rows / max(docs.count(), 1))
    drawn = docs.select("text") if share == 1.0 else docs.select("text").sample(share, seed=SEED)
    sample = materialize(drawn.limit(sample_rows), "quality-sample")

    def timed(rejects: Callable[[Column, Column], Column]) -> tuple[float, int]:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(of_text(rejects)).alias("n")).first()["n"]
            runs.append(time.perf_counter() - began)
        return min(runs), rejected

    idle, _ = timed(lambda t, w: n_words(t, w) < 0)
    worth = {}
    for rule in rules:
        cost, rejected = timed(rule.rejects)
        worth[rule.name] = rejected / max(cost - idle, LEAST_COST)
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def first_rejection(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, NULL if none does; later rules are not evaluated."""

    def cascade(t: Column, w: Column) -> Column:
        verdict = F.when(F.lit(False), F.lit(None).cast("string"))
        for rule in rules:
            verdict = verdict.when(rule.rejects(t, w), F.lit(rule.name))
        return verdict

    return of_text(cascade)


def base_features() -> Column:
    """The counts that the rules are made of, as one struct of longs."""
    counts = [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words]
    return of_text(lambda t, w: F.struct(*(f(t, w).cast("long").alias(f.__name__) for f in counts)))


def verdicts(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with ``rejected_by`` and the struct ``features``."""
    order = ordered_rules(docs, rules, sample_rows)
    named = docs.drop("rejected_by", "features").withColumn("features", base_features())
    return named.withColumn("rejected_by", first_rejection(order))


def keep(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents that no rule rejects, with the input's columns."""
    order = ordered_rules(docs, rules or [*BASE, *EXTRA], sample_rows)
    return docs.filter(first_rejection(order).isNull())
