"""Licence scans: windows of words against licence templates by Dice over word bigrams.

A text is lower-cased (A-Z) and cut into words, whatever its lines. For a template of m
word pairs, windows of m pairs are compared that start at any of its own pairs; the last
ones end with the text. With a and b different pairs and c common ones the similarity is
2c / (a + b), so the threshold t needs c >= b * t / (2 - t). This bound prunes three times:

* a text that lacks some words has lost too many pairs of a template to reach it, so it
  must contain one of a few long words (``key_words``), which is looked up in its bytes;
* the different pairs of the whole text must hold enough of the template's;
* a window is compared only if enough of the template's pairs start within it.

The templates are a literal list, so nothing is shuffled. Per template the best window
counts, the first one of equals. NULL and empty texts, and texts of one word, match
nothing; a template of one word has no pair and is refused. Matches are ordered by
similarity, then name and place. A column ``licenses`` of the input is replaced.
"""

from __future__ import annotations

import math
import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.license_texts import TEMPLATES
from shiftlens.llm.native import let, lower_ascii, sealed, unsealed, words

THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALL = 1_000_000_000
MATCH = "struct<dice:double,name:string,start:int,end:int>"


def template_pairs(text: str) -> list[str]:
    """Word pairs of a template, in order; the words are those that ``WORD`` takes from texts."""
    own = re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return [f"{a} {b}" for a, b in zip(own, own[1:])]


def needed(size: int, threshold: float) -> int:
    """Fewest common pairs with a template of ``size`` different ones, shown by a window that has no others."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))


def key_words(pairs: list[str], threshold: float) -> list[str]:
    """Long words of which any match contains one: without all of them too many pairs are lost."""
    different = set(pairs)
    spare = len(different) - needed(len(different), threshold)
    chosen: list[str] = []
    for word in sorted({w for p in different for w in p.split(" ")}, key=lambda w: (-len(w), w)):
        chosen.append(word)
        if sum(any(w in chosen for w in p.split(" ")) for p in different) > spare:
            break
    return chosen


def _best(pairs: Column, own: Column, template: Column, threshold: float) -> Column:
    """The best window of one template as a struct, NULL below the threshold."""
    places = F.array_compact(F.transform(pairs, lambda p, i: F.when(F.array_contains(own, p), i)))

    def score(start: Column) -> Column:
        window = F.array_distinct(F.slice(pairs, start + 1, template["length"]))

        def of(different: Column) -> Column:
            common = 2.0 * F.size(F.array_intersect(different, own))
            end = F.least(start + template["length"], F.size(pairs)) + 1
            return F.struct(
                (common / (F.size(different) + F.size(template["pairs"]))).alias("dice"), (-start).alias("place"), end.alias("end")
            )

        return let(window, of)

    def scored(at: Column) -> Column:
        dense = F.filter(at, lambda p, k: F.coalesce(F.get(at, k + template["needed"] - 1) < p + template["length"], F.lit(False)))
        return F.array_max(F.transform(dense, score))

    def shown(best: Column) -> Column:
        match = F.struct(best["dice"].alias("dice"), template["name"].alias("name"), (-best["place"]).alias("start"), best["end"].alias("end"))
        return F.when(best["dice"] >= threshold, match.cast(MATCH))

    return let(let(places, scored), shown)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``licenses``: (dice, name, start, end) of each match, best first; words from ``start`` up to ``end``."""
    known = [(name, template_pairs(text)) for name, text in templates or TEMPLATES]
    if not all(pairs for _, pairs in known):
        raise ValueError("a template needs two words")
    table = F.array(*(
        F.struct(
            F.lit(name).alias("name"), F.lit(sorted(set(pairs))).alias("pairs"), F.lit(len(pairs)).alias("length"),
            F.lit(needed(len(set(pairs)), threshold)).alias("needed"),
        )
        for name, pairs in known
    ))
    every = F.lit(sorted({p for _, pairs in known for p in pairs}))
    keys = sorted({w for _, pairs in known for w in key_words(pairs, threshold)})

    def matches(own_words: Column) -> Column:
        following = F.slice(own_words, 2, ALL)
        spelled = F.transform(following, lambda w, i: F.concat_ws(" ", F.get(own_words, i), w))

        def of_pairs(pairs: Column) -> Column:
            def of_common(common: Column) -> Column:
                def of_template(template: Column) -> Column:
                    own = F.array_intersect(common, template["pairs"])
                    return let(own, lambda o: F.when(F.size(o) >= template["needed"], _best(pairs, o, template, threshold)))

                return F.array_compact(F.transform(table, of_template))

            return let(F.array_intersect(pairs, every), of_common)

        return let(spelled, of_pairs)

    def of_text(low: Column) -> Column:
        maybe = reduce(lambda a, b: a | b, (F.contains(low, F.lit(k)) for k in keys))
        return F.when(maybe, let(words(low, WORD), matches)).otherwise(F.array().cast(f"array<{MATCH}>"))

    found = let(lower_ascii(F.coalesce("text", F.lit(""))), of_text)

    def order(x: Column, y: Column) -> Column:
        return (
            F.when(x["dice"] != y["dice"], F.when(x["dice"] > y["dice"], -1).otherwise(1))
            .when(x["name"] != y["name"], F.when(x["name"] < y["name"], -1).otherwise(1))
            .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
            .when(x["end"] != y["end"], F.when(x["end"] < y["end"], -1).otherwise(1))
            .otherwise(0)
        )

    return unsealed(sealed(docs, "text"), [c for c in docs.columns if c != "licenses"], ("text",), licenses=F.array_sort(found, order))
