"""Tail probabilities against published table values and identities."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from shiftlens.functions import pvalues as pv


@pytest.mark.parametrize(
    ("t", "df", "p"),
    [(2.0, 10, 0.0733880), (2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.959964, 1e9, 0.05), (0.0, 5, 1.0)],
)
def test_student_t(t, df, p):
    assert pv.student_t_two_sided(t, df) == pytest.approx(p, abs=2e-7)


@pytest.mark.parametrize(
    ("x", "df", "p"), [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (16.918978, 9, 0.05), (0.0, 3, 1.0)]
)
def test_chi_square(x, df, p):
    assert pv.chi_square_upper(x, df) == pytest.approx(p, abs=1e-7)


def test_large_df_joins_smoothly():
    below = pv.student_t_two_sided(3.0, 0.999e6)
    above = pv.student_t_two_sided(3.0, 1.001e6)
    assert below == pytest.approx(above, rel=1e-6)


def test_deep_tails_keep_precision():
    assert pv.student_t_two_sided(40.0, 60000) < 1e-200
    assert pv.chi_square_upper(400.0, 2) == pytest.approx(math.exp(-200.0), rel=1e-9)


@settings(max_examples=60, deadline=None)
@given(t=hs.floats(0.0, 30.0), df=hs.floats(1.0, 500.0))
def test_t_is_a_probability_and_falls(t, df):
    p = pv.student_t_two_sided(t, df)
    assert 0.0 <= p <= 1.0 + 1e-12
    assert pv.student_t_two_sided(t + 0.5, df) <= p + 1e-12


@settings(max_examples=60, deadline=None)
@given(t=hs.floats(0.01, 20.0))
def test_t_with_one_df_is_cauchy(t):
    assert pv.student_t_two_sided(t, 1.0) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-10)
