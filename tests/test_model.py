from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.operators import model as L
from tests.conftest import day

SCHEMA = (
    "sales_date date, stock_code string, market_id string, net_sales_qty double, avg_unit_price double, "
    "lag_7 double, lag_28 double, weekday int, is_price_missing boolean, revenue double, description string"
)


@pytest.fixture(scope="module")
def features(spark):
    data = [
        (day(n), product, market, 4.0 + level * (n % 6), 2.5 + 0.25 * (n % 4),
         4.0 + level * ((n - 7) % 6) if n >= 7 else None, None, n % 7, n % 9 == 0, 1.0, "lamp")
        for product, market, level in (("lamp-1", "NO", 1.5), ("desk-2", "SE", 3.0))
        for n in range(64)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_feature_columns(features):
    assert L.feature_columns(features) == ["avg_unit_price", "lag_7", "lag_28", "weekday", "is_price_missing"]
    with pytest.raises(ValueError, match="no numeric feature"):
        L.feature_columns(features.select("sales_date", "stock_code", "market_id", "net_sales_qty", "revenue"))


def test_prepare(features):
    train, test, names = L.prepare_train_test(features, holdout_days=10)
    assert train.count() == 108 and test.count() == 20 and "lag_7" in names
    gaps = features.withColumn("net_sales_qty", F.when(F.col("stock_code") == "desk-2", F.col("net_sales_qty")))
    assert L.prepare_train_test(gaps, holdout_days=10)[0].count() == 54
    with pytest.raises(ValueError, match="market_id"):
        L.prepare_train_test(features.drop("market_id"))


@pytest.fixture(scope="module")
def run(spark, features):
    baselines = spark.createDataFrame(
        [("late", "WMAPE", 0.9), ("best", "wmape", 0.2), ("best", "mae", 0.1)],
        "baseline string, metric string, value double",
    )
    return L.run_modeling(features, baselines, holdout_days=10, trees=5)


def test_forecast(run):
    forecast = run["forecast"]
    assert forecast.count() == 20  # missing features leave no row out
    assert forecast.where("forecast_net_sales_qty < 0 OR forecast_net_sales_qty IS NULL").count() == 0


def test_scores(run):
    metrics = run["metrics"].first().asDict()
    assert set(metrics) == {"wmape", "mae", "rmse", "bias", "service_level_proxy", "stockout_risk_rate"}
    got = [(r["source"], r["metric"]) for r in run["comparison"].collect()]
    assert got == [("model", "wmape"), ("best", "wmape")]
    assert L.compare_with_best_baseline(run["metrics"]).count() == 1


def test_importance(run, features):
    gains = {r["feature"]: r["importance"] for r in run["feature_importance"].collect()}
    assert set(gains) == set(run["feature_columns"]) and gains["lag_28"] == 0.0
    assert sum(gains.values()) == pytest.approx(1.0)
    counts = {r["feature"]: r["importance"] for r in L.split_counts(run["model"], features).collect()}
    assert set(counts) == set(gains) and sum(counts.values()) > 0
    assert all((counts[f] > 0) == (gains[f] > 0) for f in gains)


def test_negative_predictions_are_clipped(features):
    train = features.withColumn("net_sales_qty", -F.abs("net_sales_qty") - 1)
    fitted = L.train_model(train, ["lag_7", "weekday"], trees=2)
    assert L.predict_non_negative(fitted, train).agg(F.max("forecast_net_sales_qty")).first()[0] == 0.0
