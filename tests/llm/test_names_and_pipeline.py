"""Input columns with the names used inside, surrogates of persons and full formats, the pipeline on odd tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shiftlens.llm import decontamination, licenses, near_duplicates, quality, sharding, surrogates
from shiftlens.session import materialize

INSIDE = ["_key_a", "_key_b", "_changes", "_spans", "_units", "_row", "_parts", "_own", "_copies", "_bucket", "_templates", "_number", "component"]
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from every other animal in the old forest near our river "


def wide(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in INSIDE)
    return spark.createDataFrame([(*r, *(f"keep {c}" for c in INSIDE)) for r in rows], schema)


def test_inner_names_stay(spark):
    rows = [(1, "Mr. John Smith wrote to ann@corp.example"), (2, "one two three four five six"), (3, None), (4, "Released under the MIT License.")]
    docs = wide(spark, rows)
    bench = spark.createDataFrame([(1, "three four")], "item_id long, text string")
    outs = {
        "replace": surrogates.replace(docs, "k"), "remove": decontamination.remove_documents(docs, bench),
        "cut": decontamination.remove_spans(docs, bench), "keep": near_duplicates.keep_one(docs), "shard": sharding.shard(docs, 2),
        "scan": licenses.scan(docs), "quality": quality.keep(docs),
    }
    for name, out in outs.items():
        for row in out.collect():
            assert [row[c] for c in INSIDE] == [f"keep {c}" for c in INSIDE], name
    assert outs["replace"].columns == docs.columns and outs["replace"].count() == 4
    assert {r["doc_id"] for r in outs["remove"].collect()} == {1, 3, 4}


def test_one_person_one_surrogate(spark):
    text = "Dr John Smith met Mr John Smith. Mr Smith left; John Smith stayed. Mrs Ann Smith, Frau Ann Lee, господин Иван Петров, Mr Νίκος Παππάς."
    docs = spark.createDataFrame([(1, text), (2, "Prof Smith and John Smith")], "doc_id long, text string")
    first, second = (r["text"] for r in surrogates.replace(docs, "k").orderBy("doc_id").collect())
    found = re.match(
        r"Dr (\S+) (\S+) met Mr (\S+) (\S+)\. Mr (\S+) left; (\S+) (\S+) stayed\. Mrs (\S+) (\S+), Frau (\S+) (\S+), господин (\S+) (\S+), Mr (\S+) (\S+)\.$",
        first,
    )
    g = found.groups()
    assert g[0] == g[2] == g[5] and g[1] == g[3] == g[4] == g[6] == g[8]
    assert g[7] == g[9] != g[0] and g[10] != g[1]
    assert g[0].split("-")[0] in surrogates.GIVEN["latin", "m"] and g[7].split("-")[0] in surrogates.GIVEN["latin", "f"]
    assert re.fullmatch("[а-яА-Я-]+", g[11] + g[12]) and re.fullmatch("[α-ωΑ-Ω-]+", g[14])
    assert second == f"Prof {g[1]} and John Smith"
    assert not {"john", "smith", "ann", "lee"} & {w.lower() for w in g}


def test_full_format_ends(spark):
    forms = spark.range(10_000).select(F.lit("identity").alias("kind"), F.format_string("%04d", "id").alias("form"), F.lit("n").alias("gender"))
    drawn = surrogates.entity_surrogates(forms, "k")
    assert drawn.count() == 10_000 == drawn.select("surrogate").distinct().count()
    assert drawn.join(forms, drawn["surrogate"] == forms["form"]).isEmpty()
    assert not surrogates.mentions("+12345 and +10000", surrogates.patterns())


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (2, None)], [(i, PROSE * 4 + f"mail a{i % 2}@b.example") for i in range(6)] * 2])
def test_pipeline_stages(spark, rows):
    docs = wide(spark, rows)
    sf_dir = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), "test-stage")
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
