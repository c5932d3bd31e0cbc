"""Personal data replaced by keyed surrogates of the same type and form.

Entities (mail addresses, telephone, card, account and identity numbers, network
addresses, titled names) are found by pattern. Every different entity of the corpus
gets one surrogate drawn from a keyed hash, so all its mentions stay the same account.
Names are replaced word by word: one surrogate per family name and one per given name, so
"Dr John Smith", "Mr John Smith" and "Mr Smith" stay one person, and namesakes stay namesakes.
A given name keeps the gender that any of its titles tells. A full name that a title marks
is replaced in the same text without a title, too. Digits stay digits, letters keep
case, names stay Latin, Cyrillic or Greek (other scripts reuse the letters of the name; accents
are not kept), punctuation stays and checksums stay valid. A surrogate that equals an
entity of the corpus or another surrogate is drawn again, until all differ. Signed numbers
of fewer than 7 digits are no telephone numbers.

NULL and empty texts stay as they are, equal rows get equal texts, and the input's
columns are returned.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.native import KEY, sealed, sized, unsealed, with_key
from shiftlens.session import materialize

PATIENCE = 6
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
WORD = r"[^\W\d_]"

# Titles by gender, and given names to draw from by script and gender.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Simon"],
    ("latin", "f"): ["Alma", "Clara", "Diana", "Elena", "Emma", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Sara"],
    ("cyrillic", "m"): ["Антон", "Борис", "Иван", "Максим", "Олег", "Павел"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fel", "gar", "hol", "kin", "lan", "mer", "nor", "pel", "ros", "sten", "tal", "ver", "wil", "zan"],
    "cyrillic": ["ба", "вол", "гор", "дан", "жар", "зен", "кол", "лев", "мир", "нов", "пет", "сол"],
    "greek": ["βα", "δεν", "γαρ", "κιν", "λαν", "μερ", "νορ", "πελ", "ροσ", "στεν", "ταλ", "ζαν"],
}
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνοπρστυφχψω",
}


def patterns() -> list[tuple[str, re.Pattern, str]]:
    """(kind, pattern, a character that every match holds), the stricter kinds first."""
    titles = "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True))
    name = rf"(?=[^\W\d_]){WORD}+(?:[-']{WORD}+)*"
    return [
        ("mail", re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "@"),
        ("address", re.compile(rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"), "."),
        ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"), "+"),
        ("phone", re.compile(r"(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)"), "-."),
        ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), "0123456789"),
        ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"), "0123456789"),
        ("identity", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "-"),
        ("name", re.compile(rf"(?<!\w)(?P<title>{titles})(?P<gap>\.? )(?P<name>{name}(?: {name})?)"), " "),
    ]


def _account_valid(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def normal(kind: str, value: str) -> str:
    """What all mentions of one entity share."""
    if kind in ("mail", "name"):
        return value.lower()
    return re.sub(r"[^A-Za-z0-9.]" if kind == "address" else r"[^A-Za-z0-9]", "", value)


def mentions(text: str, forms: list[tuple[str, re.Pattern, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), left to right without overlaps; the stricter kind wins."""
    found, present = [], set(text)
    for kind, pattern, needed in forms:
        if not present.intersection(needed):
            continue
        for m in pattern.finditer(text):
            start, end, value = m.start(), m.end(), m[0]
            if kind == "name":
                own = m["name"].split(" ")
                capital = [w for k, w in enumerate(own) if w[0].isupper() and all(v[0].isupper() for v in own[: k + 1])]
                if not capital:
                    continue
                start = m.start("name")
                value, end = " ".join(capital), start + len(" ".join(capital))
                gender = next(g for g, titles in TITLES.items() if m["title"] in titles)
                form = f"{gender}:{normal(kind, value)}"
            else:
                form = normal(kind, value)
            if kind == "account" and not _account_valid(form) or kind == "phone" and not 7 <= len(form) <= 15:
                continue
            if all(end <= s or e <= start for s, e, *_ in found):
                found.append((start, end, kind, form))
    known = {text[s:e]: form for s, e, kind, form in found if kind == "name" and " " in text[s:e]}
    if known:
        untitled = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w)")
        taken = sorted((s, e) for s, e, *_ in found)
        for m in untitled.finditer(text):
            k = bisect.bisect(taken, (m.start(), m.end()))
            if (k == len(taken) or m.end() <= taken[k][0]) and (not k or taken[k - 1][1] <= m.start()):
                found.append((m.start(), m.end(), "name", known[m[0]]))
    return sorted(found)


class Draws:
    """A keyed stream of small numbers for one entity and one attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.block, self.count = key, "\x1f".join(parts).encode(), b"", 0

    def below(self, n: int) -> int:
        if len(self.block) < 4:
            self.block += hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.count += 1
        value, self.block = int.from_bytes(self.block[:4], "big"), self.block[4:]
        return value % n


def _script(word: str) -> str:
    for script, letters in LETTERS.items():
        if any(c in letters for c in word.lower()):
            return script
    return "latin" if word.isascii() else "own"


def _like(c: str, draw: Draws) -> str:
    if c.isdigit():
        return str(draw.below(10))
    if not c.isalpha():
        return c
    letters = LETTERS.get(_script(c), c)
    picked = letters[draw.below(len(letters))]
    return picked.upper() if c.isupper() else picked


def _digits(count: int, draw: Draws) -> str:
    return "".join(str(draw.below(10)) for _ in range(count))


def _family(word: str, length: int, draw: Draws) -> str:
    """Syllables of the word's script; letters of the word itself where no script is known."""
    script = _script(word)
    parts = SYLLABLES.get(script) or sorted(set(word))
    return "".join(parts[draw.below(len(parts))] for _ in range(length if script in SYLLABLES else len(word) + length))


def surrogate(kind: str, form: str, gender: str, key: bytes, attempt: int) -> str:
    """Normal form of the replacement of an entity, longer from attempt ``PATIENCE`` on.

    Up to then the format is kept. A format whose values are nearly all taken would never
    yield a free one; each later attempt has ten times as many values, so draws end.
    """
    draw, more = Draws(key, kind, form, str(attempt)), max(0, attempt - PATIENCE + 1)
    if kind == "mail":
        local, _, domain = form.partition("@")
        top = domain.rpartition(".")[2]
        return "".join(_like(c, draw) for c in local) + f"@mail{draw.below(1000 * 10 ** min(attempt, 6))}{_digits(more, draw)}.example.{top}"
    if kind == "address":
        first = form.split(".")[0]
        kept = first in ("10", "127", "192", "172")
        return ".".join([first if kept else str(1 + draw.below(223)), *(str(draw.below(256)) for _ in range(3 + more))])
    if kind == "family":
        return _family(form, 2 + attempt // 2, draw)
    if kind == "given":
        pool = GIVEN.get((_script(form), gender if gender != "n" else "mf"[draw.below(2)]))
        picked = pool[draw.below(len(pool))].lower() if pool else _family(form, 1, draw)
        return picked + (f"-{_family(form, (attempt + 1) // 2, draw)}" if attempt else "")
    if kind == "account":
        body = form[:2] + "00" + "".join(_like(c, draw) for c in form[4:]) + _digits(more, draw)
        moved = body[4:] + body[:4]
        return f"{body[:2]}{98 - int(''.join(str(int(c, 36)) for c in moved)) % 97:02d}{body[4:]}"
    kept = 1 if kind in ("phone", "card") else 0
    digits = form[:kept] + "".join(_like(c, draw) for c in form[kept:]) + _digits(more, draw)
    if kind == "card" and _luhn(form) == 0:
        digits = digits[:-1] + str((10 - _luhn(digits[:-1] + "0")) % 10)
    return digits


def poured(kind: str, mention: str, replacement: str) -> str:
    """A replacement's normal form in the punctuation and case of one mention."""
    if kind == "name":
        words, own = mention.split(" "), replacement.split(" ")
        return " ".join(r.upper() if w.isupper() and len(w) > 1 else r.title() for w, r in zip(words, own))
    if kind == "mail":
        return replacement.upper() if mention.isupper() else replacement
    if kind == "address":
        return replacement
    rest = iter(replacement)
    return "".join([next(rest) if c.isalnum() else c for c in mention] + [*rest])


def _mentions(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = patterns()
        for batch in batches:
            rows = []
            for k, text in enumerate(batch["text"].to_pylist()):
                rows += [(k, *m) for m in (mentions(text, forms) if text else ())]
            row = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch[c].take(row) for c in KEY]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()]
            columns += [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "start", "end", "kind", "form"])

    keyed = with_key(docs.select("doc_id", "text"), "doc_id", "text")
    kind = f"{KEY[0]} long, {KEY[1]} long, start int, end int, kind string, form string"
    return materialize(keyed.select("text", *KEY).mapInArrow(work, kind), "entity-mentions")


def entity_surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) of (kind, form, gender) rows: all different, and none of them a form that occurs.

    Ends for certain: forms are finitely many, and the values to draw from grow without
    bound (see ``surrogate``), so each round settles a share of what is left.
    """
    secret = key.encode()
    known = F.min(F.when(F.col("gender") != "n", F.col("gender")))
    entities = materialize(parts.groupBy("kind", "form").agg(F.coalesce(known, F.lit("n")).alias("gender")), "entities")
    taken, settled, attempt = entities.select("kind", F.col("form").alias("surrogate")), None, 0
    todo = entities
    while True:

        def work(batches: Iterator[pa.RecordBatch], attempt: int = attempt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch[c].to_pylist() for c in ("kind", "form", "gender")))
                drawn = pa.array([surrogate(k, f, g, secret, attempt) for k, f, g in rows], pa.string())
                columns = [*(batch[c] for c in ("kind", "form", "gender")), drawn]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "form", "gender", "surrogate"])

        kinds = "kind string, form string, gender string, surrogate string"
        drawn = materialize(todo.select("kind", "form", "gender").mapInArrow(work, kinds), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))
        won = materialize(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "form", "surrogate"), "won")
        settled = won if settled is None else settled.unionByName(won)
        taken = taken.unionByName(won.select("kind", "surrogate"))
        todo = materialize(todo.join(won.select("kind", "form"), ["kind", "form"], "left_anti"), "again")
        if todo.isEmpty():
            return settled
        attempt += 1


def _named(found: DataFrame, key: str) -> DataFrame:
    """Mentions with the surrogate of the whole entity, words of names put together again."""
    split = F.split(F.substring_index("form", ":", -1), " ")
    own = F.when(F.col("kind") == "name", split).otherwise(F.array("form"))
    entities = materialize(found.select("kind", "form").distinct(), "entity-forms")
    last = F.size(own) - 1
    parts = entities.select("kind", "form", own.alias("own"), last.alias("last"), F.substring_index("form", ":", 1).alias("gender"))
    parts = parts.select("kind", "form", "last", "gender", F.posexplode("own").alias("place", "part"))
    name = F.col("kind") == "name"
    part_kind = F.when(~name, F.col("kind")).when(F.col("place") < F.col("last"), "given").otherwise("family")
    gender = F.when(name & (F.col("place") < F.col("last")), F.col("gender")).otherwise("n")
    parts = parts.select("kind", "form", "place", part_kind.alias("part_kind"), "part", gender.alias("gender"))
    drawn = entity_surrogates(parts.select(F.col("part_kind").alias("kind"), F.col("part").alias("form"), "gender"), key)
    drawn = drawn.select(F.col("kind").alias("part_kind"), F.col("form").alias("part"), "surrogate")
    joined = parts.join(drawn, ["part_kind", "part"]).groupBy("kind", "form")
    words = F.transform(F.sort_array(F.collect_list(F.struct("place", "surrogate"))), lambda p: p["surrogate"])
    return found.join(joined.agg(F.array_join(words, " ").alias("surrogate")), ["kind", "form"])


def replace(docs: DataFrame, key: str, with_count: str | None = None) -> DataFrame:
    """The documents with surrogates in their texts; ``with_count`` names a column for the mentions replaced."""
    found = _mentions(docs)
    named = _named(found, key)
    changes = F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("_changes")
    # Equal rows find the same mentions; one copy of each is enough.
    per_doc = materialize(named.dropDuplicates([*KEY, "start"]).groupBy(*KEY).agg(changes), "entity-changes")
    joined = with_key(sealed(docs, "doc_id", "text"), "doc_id", "text").join(sized(per_doc, "_changes"), KEY, "left")

    @F.pandas_udf("string")
    def rewritten(texts, changes):
        out = []
        for text, own in zip(texts, changes):
            if text is not None and own is not None:
                at, parts = 0, []
                for c in own:
                    parts += [text[at : c["start"]], poured(c["kind"], text[c["start"] : c["end"]], c["surrogate"])]
                    at = c["end"]
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    columns = [c for c in docs.columns if c != with_count]
    count = {with_count: F.coalesce(F.size("_changes"), F.lit(0)).cast("long")} if with_count else {}
    none = {with_count: F.lit(0).cast("long")} if with_count else {}
    changed = joined.filter(F.col("_changes").isNotNull())
    same = joined.filter(F.col("_changes").isNull())
    return unsealed(changed, columns, text=rewritten("text", "_changes"), **count).unionByName(unsealed(same, columns, **none))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
