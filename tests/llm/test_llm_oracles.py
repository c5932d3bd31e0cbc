"""Queries of the subpackage against their SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect

from shiftlens.llm.oracles import ORACLES
from shiftlens.llm.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = connect(SF_DIR)
    assert compare(REGISTRY[name](spark, SF_DIR), con, ORACLES[name]) == []
    con.close()
