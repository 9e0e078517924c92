from __future__ import annotations

import __spark_entry__ as driver
from shelfline.schema import MART_SCHEMA


def test_entry(spark):
    mart = driver.entry(spark)
    assert mart.columns == MART_SCHEMA.fieldNames() and mart.count() > 0


def test_contract():
    queries = driver.queries()
    assert set(driver.oracle_sql()) <= set(queries) and all(callable(q) for q in queries.values())
