"""Corpus queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from auditloom.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []
