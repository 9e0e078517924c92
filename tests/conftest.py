from __future__ import annotations

import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folders = tmp_path_factory.mktemp("spark")
    session = local_session(
        4,
        "6g",
        spark__checkpoint__dir=str(folders / "shared"),
        spark__sql__warehouse__dir=str(folders / "warehouse"),
        spark__sql__shuffle__partitions="4",
    )
    yield session
    session.stop()


def day(n: int, start: date = date(2024, 1, 1)) -> date:
    return start + timedelta(days=n)


def rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def by_key(df, *keys: str) -> dict:
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


MART = (
    "sales_date date, stock_code string, market_id string, net_sales_qty double, "
    "avg_unit_price double, invoices_cnt bigint, customers_cnt bigint, revenue double"
)
SALES = "sales_date date, stock_code string, market_id string, net_sales_qty double"
FORECAST = SALES + ", forecast_net_sales_qty double"


@pytest.fixture(scope="session")
def sales(spark):
    """Two series of 35 days: 1..35 and 10..350."""
    data = [(day(i), "A", "UK", float(i + 1)) for i in range(35)]
    data += [(day(i), "B", "UK", float(10 * (i + 1))) for i in range(35)]
    return spark.createDataFrame(data, SALES)


@pytest.fixture(scope="session")
def daily(spark):
    """One product in two markets, 1..10 and 101..110, with a price step on day 8."""
    data = []
    for market, base in (("UK", 0), ("FR", 100)):
        for i in range(10):
            price = 10.0 if i < 7 else 12.0
            data.append((day(i), "A", market, float(base + i + 1), price, i, i + 1, price * (i + 1)))
    return spark.createDataFrame(data, MART)


@pytest.fixture(scope="session")
def forecast(spark):
    actual, predicted = [10.0, 15.0, 0.0, -2.0], [8.0, 20.0, 0.0, 3.0]
    data = [(day(i), "A", "UK", actual[i], predicted[i]) for i in range(4)]
    data += [(day(i), "B", "FR", 1.0, 2.0) for i in range(4)]
    return spark.createDataFrame(data, FORECAST)
