"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from catalog.oracles import ORACLES
from catalog.queries import REGISTRY
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
NO_SQL: set[str] = set()


def test_every_query_has_sql_or_a_reason():
    assert set(REGISTRY) - set(ORACLES) == NO_SQL
    assert set(REGISTRY) <= set(entry.queries())
    assert set(ORACLES) <= set(REGISTRY)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert compare(REGISTRY[name](spark, SF_DIR), duck, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_gives_rows(spark, name):
    assert REGISTRY[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
