from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from shelfline.functions.columns import moment, number
from shelfline.operators import mart as M
from tests.conftest import by_key, rows

SCHEMA = (
    "invoice string, stock_code string, description string, quantity double, "
    "invoice_date timestamp, unit_price double, customer_id string, country string"
)
NOON = datetime(2024, 1, 6, 12)


def facts(spark, *data):
    return M.prepare_transactions(spark.createDataFrame(list(data), SCHEMA))


def test_flags_and_revenue(spark):
    df = facts(
        spark,
        ("1", "A", " mug ", 2.0, NOON, 3.0, "c", " UK "),
        ("C2", "A", "mug", 1.0, NOON, 0.0, "c", "UK"),
        ("3", "A", "mug", -4.0, NOON, None, None, "UK"),
        (None, " A", None, None, None, float("nan"), None, None),
    )
    got = rows(df)
    assert [r["is_return_flag"] for r in got] == [False, True, True, False]
    assert [r["is_price_missing"] for r in got] == [False, False, True, True]
    assert [r["is_price_invalid"] for r in got] == [False, True, True, True]
    assert [r["revenue"] for r in got] == [6.0, 0.0, None, None]
    assert got[0]["description"] == "mug" and got[0]["market_id"] == "UK"
    assert got[0]["sales_date"] == date(2024, 1, 6) and got[3]["stock_code"] == " A"


def test_mart_row(spark):
    df = facts(
        spark,
        ("1", "A", "b", 5.0, NOON, 2.0, "c1", "UK"),
        ("1", "A", "a", 3.0, NOON, 4.0, "c1", "UK"),
        ("C2", "A", "z", 2.0, NOON, 6.0, "c2", "UK"),
        ("C3", "A", None, -4.0, NOON, -1.0, None, "UK"),
        ("4", None, "x", 1.0, NOON, 1.0, "c", "UK"),
        ("5", "A", "x", 1.0, None, 1.0, "c", "UK"),
    )
    got = rows(M.daily_sales_mart(df))
    assert len(got) == 1
    row = got[0]
    assert row["sales_qty"] == 8.0 and row["net_sales_qty"] == 6.0
    assert row["returns_qty"] == 2.0  # |2 - 4|, not 2 + 4
    assert row["avg_unit_price"] == 4.0 and row["revenue"] == 38.0
    assert row["invoices_cnt"] == 3 and row["customers_cnt"] == 2
    assert row["description"] == "a" and row["is_return_flag"] and not row["is_price_missing"]
    assert row["weekday"] == 6 and row["is_weekend"] and row["month"] == 1 and row["year"] == 2024


def test_no_valid_price_gives_no_mean(spark):
    got = rows(M.daily_sales_mart(facts(spark, ("1", "A", "a", 5.0, NOON, 0.0, "c", "UK"))))[0]
    assert got["avg_unit_price"] is None and got["revenue"] == 0.0


def test_dimensions(spark):
    df = facts(
        spark,
        ("1", "A", "b", 1.0, NOON, 1.0, "c", " UK"),
        ("2", "A", "a", 1.0, NOON, 1.0, "c", "UK"),
        ("3", "B", "y", 1.0, NOON, 1.0, "c", "FR"),
        ("4", "B", "z", 1.0, NOON, 1.0, "c", "FR"),
        ("5", "B", "z", 1.0, None, 1.0, "c", None),
    )
    assert {r["stock_code"]: r["description"] for r in rows(M.dim_product(df))} == {"A": "a", "B": "z"}
    assert {r["market_id"] for r in rows(M.dim_market(df))} == {"UK", "FR"}
    assert rows(M.dim_date(df)) == [
        {"sales_date": date(2024, 1, 6), "weekday": 6, "month": 1, "year": 2024, "is_weekend": True}
    ]
    assert M.duplicate_keys(M.dim_product(df), ["stock_code"]).count() == 0
    assert by_key(M.duplicate_keys(df, ["stock_code"]), "stock_code")[("B",)]["rows"] == 3


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readers_prune_the_mart(spark, tmp_path):
    """A part that no selected column needs is neither joined nor read."""
    path = str(tmp_path / "facts")
    facts(spark, ("1", "A", "a", 1.0, NOON, 1.0, "c", "UK")).write.parquet(path)
    df = spark.read.parquet(path)
    mart = M.daily_sales_mart(df)
    whole, sums = plan_of(mart), plan_of(mart.select(*M.MART_KEYS, "net_sales_qty"))
    assert "Generate" not in whole and "Expand" not in whole and whole.count("FileScan") == 4
    assert sums.count("Exchange") == 1 and "Sort" not in sums and "Join" not in sums
    assert sums.count("FileScan") == 1
    read = sums[sums.index("ReadSchema"):]
    assert not any(name in read for name in ("invoice:", "customer_id", "description"))
    invoices = plan_of(mart.select(*M.MART_KEYS, "invoices_cnt"))
    assert invoices.count("FileScan") == 2 and "customer_id" not in invoices
    assert plan_of(M.daily_sums(df)).count("Exchange") == 1


def test_sums_are_the_marts(spark):
    df = facts(
        spark,
        ("1", "A", "b", 2.0, NOON, 3.0, "c", "UK"),
        ("1", "A", "a", 1.0, NOON, None, "d", "UK"),
        ("C2", "A", None, -1.0, NOON, 3.0, None, "UK"),
    )
    mart, sums = M.daily_sales_mart(df), M.daily_sums(df)
    assert rows(mart.select(*sums.columns)) == rows(sums)
    whole = rows(mart)[0]
    assert (whole["description"], whole["invoices_cnt"], whole["customers_cnt"]) == ("a", 2, 2)


def test_date_and_number_spellings(spark):
    texts = ["12/1/2010 8:26:00", "12/1/10 8:26", "12-01-2010 08:26", "1 Dec 2010", "20101201", "2010-12-01T08:26:00",
             "13/13/2010", "8:26", "12/1/97", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r["d"])[:10] for r in df.select(F.to_date(moment(df, "t")).alias("d")).collect()]
    assert got == ["2010-12-01"] * 6 + ["None", "None", "1997-12-01", "None", "None"]
    numbers = ["0x1p3", "12d", "12f", " 1.5 ", "-.5e2", "1,5", "NaN", "7.", "1e400", None]
    df = spark.createDataFrame([(t,) for t in numbers], "t string")
    got = [r["v"] for r in df.select(number(df, "t").alias("v")).collect()]
    assert got == [None, None, None, 1.5, -50.0, None, None, 7.0, float("inf"), None]
