"""Every query against its SQL counterpart on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from checks.compare import connect, difference, type_difference
from checks.oracles import ORACLES
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    assert type_difference(result, duck, ORACLES[name]) == ""
    assert difference(result.toPandas(), duck.execute(ORACLES[name]).df()) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
