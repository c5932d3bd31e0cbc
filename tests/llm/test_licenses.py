"""Licence scans: places in texts, bounds, and a plain version over all windows."""

from __future__ import annotations

import random
import re

import pytest

from shiftlens.llm import licenses
from shiftlens.llm.license_texts import TEMPLATES

FULL = dict((name, text) for name, text in TEMPLATES if len(text) > 900)


def plain(text: str | None, templates, threshold=licenses.THRESHOLD):
    """Every window that starts at a pair of the template, compared one by one."""
    own, found = licenses.template_pairs(text or ""), []
    for name, known in templates:
        pairs = licenses.template_pairs(known)
        best = None
        for start in range(len(own)):
            window = own[start:start + len(pairs)]
            if window[0] not in pairs:
                continue
            common = len(set(window) & set(pairs))
            dice = 2.0 * common / (len(set(window)) + len(set(pairs)))
            if dice >= threshold and (best is None or dice > best[0]):
                best = (dice, name, start, start + len(window) + 1)
        if best:
            found.append(best)
    return sorted(found, key=lambda m: (-m[0], m[1], m[2], m[3]))


def scanned(spark, texts, templates=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = sorted(licenses.scan(docs, templates).collect(), key=lambda r: r["doc_id"])
    return [[tuple(m) for m in r["licenses"]] for r in rows]


def test_inline_wrapped_and_full_texts(spark):
    mit = re.sub(r"(.{60}\S*) ", r"\1\n", FULL["MIT"])
    texts = [
        "Some code. Released under the MIT License. See the file.",
        "# This work is licensed under the GNU\n# General Public License, version 3.\nand more",
        f"Copyright 2020 Someone\n\n{mit}\n\nint main() {{}}",
        FULL["BSD-3-Clause"].upper(),
        "the license of the software is under discussion, all rights are reserved by others",
        None, "", "license", "All rights reserved.",
    ]
    found = scanned(spark, texts)
    assert [m[0][1] if m else None for m in found] == ["MIT", "GPL-3.0", "MIT", "BSD-3-Clause", None, None, None, None, "proprietary"]
    assert found[0][0] == (1.0, "MIT", 2, 7)
    assert found[2][0][2:] == (3, 3 + len(licenses.template_pairs(mit)) + 1) and found[2][0][0] == 1.0


def test_equals_plain_version(spark):
    pick = random.Random(5)
    texts = []
    for k in range(60):
        name, known = TEMPLATES[k % len(TEMPLATES)]
        own = known.split()
        for _ in range(pick.randrange(0, 1 + len(own) // 6)):
            place = pick.randrange(len(own))
            own[place:place + 1] = pick.choice([[], ["other"], [own[place], "words"]])
        around = [pick.choice(["license", "under", "the", "by", "code", "software", "x"]) for _ in range(pick.randrange(30))]
        texts.append(" ".join(around + own + (own[: len(own) // 2] if k % 3 else own) + around))
    texts += ["all rights all rights all rights reserved", "the the the the", "Copyright © Holder of été"]
    templates = [*TEMPLATES, ("own", "Copyright © Holder of été"), ("twice", "go on and go on and stop")]
    texts.append("go on and go on and stop and go on")
    assert scanned(spark, texts, templates) == [plain(t, templates) for t in texts]


def test_templates(spark):
    for _, text in TEMPLATES:
        pairs = set(licenses.template_pairs(text))
        keys = licenses.key_words(licenses.template_pairs(text), licenses.THRESHOLD)
        left = [p for p in pairs if not set(p.split(" ")) & set(keys)]
        assert len(left) < licenses.needed(len(pairs), licenses.THRESHOLD)
    with pytest.raises(ValueError, match="two words"):
        scanned(spark, ["x"], [("one", "word")])
