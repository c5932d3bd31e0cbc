"""Whitening against numpy's own decomposition, counts of eigenvalues, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shiftlens.llm import queries as q
from shiftlens.llm import whitening

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, component int, packed string, n string, _vector int"


def table(spark, vectors):
    rows = [(i, v, 1, "p", "n", 2) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(vectors, count=4):
    kept = [(i, [math.floor(256.0 * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, sums = len(fit), [sum(int(v) for v in column) for column in fit.T]
    centred = fit - np.array([s / n for s in sums])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:count]
    out = {}
    for i, x in kept:
        for k, o in enumerate(order):
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            share = float((np.array(x) - np.array([s / n for s in sums])) @ vectors[:, o] / math.sqrt(values[o]))
            out[i, k + 1] = (n, deviation, share, values[o] / np.trace(v))
    return out


def agrees(rows, want):
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted(want)
    signs = {}
    for r in rows:
        n, deviation, share, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        if abs(share) > 1e-6:
            sign = signs.setdefault(r["component"], np.sign(share) * np.sign(r["whitened"]))
            assert r["whitened"] * sign == pytest.approx(share, abs=1e-7)
        assert 0 <= r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in rows}) == 1


def test_given_vectors(spark):
    source = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    agrees(q.op12_whitening(spark, SF_DIR).collect(), plain([tuple(r) for r in source]))


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, [float(v) for v in draw.normal(size=6) * [9, 5, 3, 2, 1, 1]]) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(300)]
    odd = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [])]
    df = table(spark, vectors + odd)
    rows = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    agrees(rows, plain(vectors))
    again = df.union(df.filter("vec_id < 100"))
    assert whitening.whiten(again, whitening.fit_whitening(again)).count() == 4 * 800


def test_no_variance(spark):
    for vectors in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = table(spark, vectors)
        assert whitening.whiten(df, whitening.fit_whitening(df)).collect() == []
    line = table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(20)])
    rows = whitening.whiten(line, whitening.fit_whitening(line)).collect()
    assert {r["component"] for r in rows} == {1} and rows[0]["explained"] == pytest.approx(1)


def test_lengths_must_agree(spark):
    df = table(spark, [(1, [1.0, 2.0]), (2, [1.0])])
    with pytest.raises(ValueError, match="different lengths"):
        whitening.fit_whitening(df)


def test_large_entries_are_exact():
    model = whitening.Whitening(3, np.array([2**40, -5], object), np.array([1.0]), np.array([[1.0, 0.0]]), 1.0)
    x = np.array([[2**20, 4], [2**40, 2**55]])
    want = [(3 * 2**20 - 2**40) ** 2 + 17**2, None]
    assert model.deviations(x[:1]).to_pylist() == [None if want[0] >= 2**63 else want[0]]
    assert model.deviations(x).to_pylist()[1] is None


def test_inertia_counts_eigenvalues():
    draw = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 25):
        for _ in range(20):
            a = np.round(draw.normal(size=(d, d)) * 3)
            a = a + a.T
            values = np.linalg.eigvalsh(a)
            if np.abs(values).min() > 1e-6:
                assert whitening.inertia(a) == ((values > 0).sum(), (values < 0).sum())
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [5, 5, 5, 2, 1], [1, 1, 1, 1, 1], [7, 7 - 1e-9, 3, 3, 0], [1e6, 1, 1e-3, 0, 0]])
def test_close_and_equal_eigenvalues(values):
    q_, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(5, 5)))
    v = q_ @ np.diag(np.array(values, float)) @ q_.T
    v = (v + v.T) / 2
    got, vectors = whitening.leading_pairs(v, 4)
    want = [x for x in sorted(values, reverse=True)[:4] if x > 0]
    assert got == pytest.approx(want, rel=1e-7)
    assert np.abs(vectors @ vectors.T - np.eye(len(want))).max() < 1e-12
    assert np.abs(v @ vectors.T - vectors.T * got).max() < 1e-8 * max(values)
