from __future__ import annotations

import pytest

from shelfline import schema as S
from shelfline.sources import io
from tests.conftest import day, rows

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


def empty(spark, *names):
    return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))


def test_transaction_headers(spark):
    df = empty(spark, "InvoiceNo", " StockCode ", "UnitPrice", "Customer ID", "Invoice-Date", "Extra  Col")
    assert S.normalize_column_names(df).columns == [
        "invoice", "stock_code", "unit_price", "customer_id", "invoice_date", "extra_col",
    ]


def test_clashing_headers(spark):
    with pytest.raises(ValueError, match="unit_price"):
        S.normalize_column_names(empty(spark, "Price", "UnitPrice"))


def test_dashboard_headers(spark):
    df = empty(spark, "Date", "Stock-Code", "forecast_bias", "Reorder Point", "Model Forecast")
    assert S.normalize_dashboard_columns(df).columns == [
        "sales_date", "stock_code", "bias", "suggested_reorder_point", "forecast_sales",
    ]


def test_require_columns(spark):
    df = empty(spark, "b")
    assert S.require_columns(df, ["b"]) is df
    with pytest.raises(ValueError, match="a, c"):
        S.require_columns(df, ["c", "b", "a"], "table")


def test_read_transactions(spark, tmp_path):
    first, second = tmp_path / "one.csv", tmp_path / "two.csv"
    first.write_text(HEADER + '1,A1,"Mug, ""large""",2,2011-01-01 10:00:00,10.5,7,United Kingdom\n')
    second.write_text("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
                      "C2,NA,  pad ,x,12/1/2010 8:26,,nan,France\n")
    got = {r["invoice"]: r for r in rows(io.read_transactions(spark, [str(first), str(second)]))}
    assert got["1"]["description"] == 'Mug, "large"'
    assert got["C2"]["stock_code"] is None and got["C2"]["customer_id"] is None
    assert got["C2"]["description"] == "  pad "
    assert got["C2"]["quantity"] == "x" and got["C2"]["unit_price"] is None


def test_read_transactions_rejects(spark, tmp_path):
    with pytest.raises(ValueError, match="xlsx"):
        io.read_transactions(spark, "book.xlsx")
    lacking = tmp_path / "lacking.csv"
    lacking.write_text("Invoice,Price\n1,2\n")
    with pytest.raises(ValueError, match="stock_code"):
        io.read_transactions(spark, str(lacking))


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_write_and_read_source(spark, forecast, tmp_path, kind):
    path = io.write_forecast(forecast, str(tmp_path / f"forecast.{kind}"), kind)
    back = io.read_source(spark, path, ["sales_date", "actual_sales", "forecast_sales"])
    assert back.columns == ["sales_date", "stock_code", "market_id", "actual_sales", "forecast_sales"]
    assert back.count() == 8


def test_write_reports_and_views(spark, forecast, tmp_path):
    paths = io.write_reports({"a": forecast, "b": forecast.limit(1)}, str(tmp_path))
    assert [spark.read.parquet(p).count() for p in paths] == [8, 1]
    io.register_views({"fva": forecast})
    assert spark.sql("SELECT COUNT(*) FROM fva").first()[0] == 8
    with pytest.raises(ValueError):
        io.write_table(forecast, str(tmp_path / "x"), "xml")


def test_partitioned_mart(spark, forecast, tmp_path):
    dated = forecast.selectExpr("*", "year(sales_date) AS year", "month(sales_date) AS month")
    path = io.write_table(dated, str(tmp_path / "mart"), partition_by=["year", "month"])
    plan = spark.read.parquet(path).where("year = 2024 AND month = 1")
    assert plan.count() == 8
    assert "PartitionFilters: [isnotnull(year" in plan._jdf.queryExecution().executedPlan().toString()
    assert len(plan.inputFiles()) == 1


def test_blank_text_survives_csv(spark, tmp_path):
    df = spark.createDataFrame([(day(0), " A ", "UK", 1.0, 2.0)],
                               "sales_date date, stock_code string, market_id string, "
                               "net_sales_qty double, forecast_net_sales_qty double")
    path = io.write_table(df, str(tmp_path / "t.csv"), "csv")
    assert rows(io.read_csv(spark, path))[0]["stock_code"] == " A "


def test_conform_reads_junk_as_missing(spark):
    df = spark.createDataFrame([("x", "2024-01-01")], "quantity string, sales_date string")
    fields = [f for f in S.FACT_SCHEMA.fields if f.name in ("quantity", "sales_date")]
    got = rows(S.conform(df, S.T.StructType(fields)))[0]
    assert got == {"quantity": None, "sales_date": day(0)}
