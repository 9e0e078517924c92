from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.operators import dashboard as D
from shelfline.operators import inventory as I
from shelfline.operators import reports as R
from shelfline.schema import DASHBOARD_COLUMNS
from tests.conftest import by_key, day, rows

SEGMENTS = "stock_code string, market_id string, abc_segment string, xyz_segment string, abc_xyz_segment string, revenue double"


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame([("A", "UK", "A", "X", "AX", 90.0), ("B", "FR", "C", "Z", "CZ", 10.0)], SEGMENTS)


@pytest.fixture(scope="module")
def policy(forecast):
    return I.inventory_policy_table(forecast)


def test_dashboard(forecast, segments, policy):
    board = D.dashboard_dataset(forecast, segments, policy)
    assert board.columns == DASHBOARD_COLUMNS and board.count() == 8
    row = by_key(board, "sales_date", "stock_code")[(day(3), "A")]
    assert row["forecast_error"] == -5.0 and row["abs_forecast_error"] == 5.0
    # Group metrics are unclipped: actual 10, 15, 0, -2 against 8, 20, 0, 3.
    assert row["wmape"] == pytest.approx(12 / 27) and row["bias"] == pytest.approx(8 / 27)
    assert row["mae"] == 3.0 and row["rmse"] == pytest.approx((54 / 4) ** 0.5)
    assert row["revenue"] == 90.0 and row["description"] == "" and row["stockout_risk_flag"]
    assert row["suggested_reorder_point"] == by_key(policy, "stock_code")[("A",)]["suggested_reorder_point"]


def test_dashboard_without_match(forecast, segments, policy):
    board = D.dashboard_dataset(forecast, segments.where("stock_code = 'A'"), policy.where("stock_code = 'A'"))
    row = by_key(board, "sales_date", "stock_code")[(day(0), "B")]
    assert row["abc_segment"] is None and row["revenue"] is None and row["wmape"] == 1.0


def test_forecast_columns_win(forecast, segments, policy):
    own = forecast.withColumns({"revenue": F.lit(1.0), "description": F.lit("mug"), "wmape": F.lit(9.0)})
    row = D.dashboard_dataset(own, segments, policy).first()
    assert row["revenue"] == 1.0 and row["description"] == "mug" and row["wmape"] != 9.0


def test_dashboard_errors(forecast, segments, policy):
    with pytest.raises(ValueError, match="abc_segment"):
        D.dashboard_dataset(forecast, segments.drop("abc_segment"), policy)
    with pytest.raises(ValueError, match="no rows"):
        D.dashboard_dataset(forecast.where("1 = 0"), segments, policy, require_rows=True)


def test_text_numbers_are_read(spark, segments, policy):
    text = spark.createDataFrame(
        [("2024-01-01", "A", "UK", "3", "x"), ("junk", "A", "UK", None, "1")],
        "sales_date string, stock_code string, market_id string, actual string, forecast string",
    )
    got = rows(D.dashboard_dataset(text, segments, policy).orderBy("actual_sales"))
    assert [(r["actual_sales"], r["forecast_sales"]) for r in got] == [(0.0, 1.0), (3.0, 0.0)]
    assert got[0]["sales_date"] is None and got[0]["forecast_error"] == -1.0


def test_choose_source(spark, policy):
    both = policy.withColumn("source", F.lit("Model")).unionByName(policy.withColumn("source", F.lit("other")))
    chosen = D.choose_inventory_source(both)
    assert chosen.count() == 2 and {r["source"] for r in rows(chosen)} == {"Model"}
    assert D.choose_inventory_source(both.where("source = 'other'")).count() == 2
    assert D.choose_inventory_source(policy.unionByName(policy)).count() == 2


def test_filters(forecast, segments, policy):
    board = D.dashboard_dataset(forecast, segments, policy)
    got = D.filter_dashboard(board, period=(day(1), day(3)), markets=["UK"], products=["A"], abc=["A"], xyz=["X"], abs_error=(1, 5))
    assert {r["sales_date"] for r in rows(got)} == {day(1), day(3)}
    assert D.filter_dashboard(board).count() == 8
    assert [r["sales_date"] for r in rows(D.dashboard_order(board))][:2] == [day(0), day(0)]


def test_error_reports(forecast, segments):
    markets = by_key(R.error_by_market(forecast), "market_id")
    assert markets[("UK",)]["abs_error_share"] == pytest.approx(12 / 16)
    assert [r["abc_xyz_segment"] for r in rows(R.error_by_segment(forecast, segments))] == ["CZ", "AX"]
    assert R.error_by_product(forecast, 1).first()["stock_code"] == "A"
    daily = by_key(R.daily_actual_vs_forecast(forecast), "sales_date")
    assert daily[(day(0),)]["actual_sales"] == 11.0 and daily[(day(0),)]["forecast_sales"] == 10.0


def test_segment_reports(forecast, segments, policy):
    matrix = by_key(R.abc_xyz_matrix(segments), "abc_segment")
    assert matrix[("A",)]["X_groups"] == 1 and matrix[("A",)]["X_revenue_share"] == 0.9
    assert matrix[("C",)]["X_groups"] == 0 and matrix[("C",)]["Z_revenue_share"] == pytest.approx(0.1)
    risk = by_key(R.risk_matrix(policy, segments), "market_id")
    assert risk[("FR",)]["overstock_share"] == 1.0 and risk[("FR",)]["stockout_share"] == 0.0
    wide = forecast.withColumnRenamed("forecast_net_sales_qty", "m").withColumn("n", F.lit(0.0))
    got = by_key(R.forecasts_by_segment(wide, segments, {"model": "m", "naive": "n"}), "abc_xyz_segment", "source")
    assert got[("AX", "model")]["best_source"] == "model" and got[("AX", "naive")]["wmape"] == 1.0
    assert got[("CZ", "naive")]["best_source"] == "model"
