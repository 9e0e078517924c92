"""Queries whose result SQL can express, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from checks.compare import connect, difference, type_difference
from shelfline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = connect(FOLDER)
    result = QUERIES[name](spark, FOLDER)
    assert type_difference(result, con, ORACLES[name]) == ""
    assert difference(result.toPandas(), con.execute(ORACLES[name]).df()) == ""


def test_all_are_there():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
