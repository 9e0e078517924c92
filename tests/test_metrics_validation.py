from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.functions import metrics as E
from shelfline.operators import validation as V
from tests.conftest import day, rows


def score(spark, metric, pairs, *args):
    df = spark.createDataFrame(pairs, "a double, f double")
    return df.agg(metric(F.col("a"), F.col("f"), *args)).first()[0]


VECTORS = [(100.0, 90.0), (200.0, 220.0), (300.0, 330.0)]


def test_error_metrics(spark):
    assert score(spark, E.mae, VECTORS) == 20.0
    assert score(spark, E.rmse, VECTORS) == pytest.approx((1400 / 3) ** 0.5)
    assert score(spark, E.wmape, VECTORS) == pytest.approx(0.1)
    assert score(spark, E.forecast_bias, VECTORS) == pytest.approx(40 / 600)


def test_no_demand(spark):
    zeros, over, under = [(0.0, 0.0)] * 2, [(0.0, 1.0), (0.0, 2.0)], [(0.0, -1.0)]
    assert score(spark, E.wmape, zeros) == 0.0 and score(spark, E.forecast_bias, zeros) == 0.0
    assert score(spark, E.wmape, over) == 1.0 and score(spark, E.forecast_bias, over) == 1.0
    assert score(spark, E.forecast_bias, under) == -1.0


def test_service_and_stockout(spark):
    assert score(spark, E.service_level_proxy, [(10.0, 10.0), (20.0, 18.0), (30.0, 35.0)]) == pytest.approx(2 / 3)
    pairs = [(10.0, 10.0), (20.0, 18.0), (30.0, 25.0)]
    assert score(spark, E.stockout_risk_rate, pairs, 2.0) == pytest.approx(1 / 3)


@pytest.mark.parametrize("metric", [E.mae, E.rmse, E.wmape, E.forecast_bias, E.service_level_proxy, E.stockout_risk_rate])
def test_empty_is_zero(spark, metric):
    assert score(spark, metric, []) == 0.0


def test_half_known_pairs_are_left_out(spark):
    assert score(spark, E.wmape, [*VECTORS, (1e6, None), (None, 1e6)]) == pytest.approx(0.1)


def test_metrics_table(spark):
    df = spark.createDataFrame(VECTORS, "a double, f double")
    assert [r["metric"] for r in rows(E.metrics_table(df, "a", "f"))] == E.METRICS
    assert E.evaluate(df, "a", "f").columns == E.METRICS


@pytest.fixture(scope="module")
def dated(spark):
    return spark.createDataFrame([(day(i), i) for i in range(80)], "sales_date date, value int")


def test_holdout(dated):
    train, holdout = V.train_holdout_split(dated, "sales_date", 28)
    assert holdout.count() == 28 and train.count() == 52
    assert train.agg(F.max("sales_date")).first()[0] < holdout.agg(F.min("sales_date")).first()[0]
    labelled = V.label_holdout(dated, "sales_date", 28)
    assert labelled.where("role = 'holdout'").count() == 28


def test_holdout_errors(dated):
    with pytest.raises(ValueError, match="nowhere"):
        V.train_holdout_split(dated, "nowhere", 28)
    with pytest.raises(Exception, match="not enough dates"):
        V.train_holdout_split(dated, "sales_date", 80)[0].count()
    assert V.train_holdout_split(dated, "sales_date", 79)[0].count() == 1


def test_holdout_filter_reaches_the_scan(spark, dated, tmp_path):
    dated.write.parquet(str(tmp_path / "dated"))
    stored = spark.read.parquet(str(tmp_path / "dated"))
    plan = V.train_holdout_split(stored, "sales_date", 28)[1]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(sales_date)" in plan


def test_splits_move_forward(dated):
    folds = rows(V.make_time_splits(dated, "sales_date", 3, 7))
    assert [f["split"] for f in folds] == [1, 2, 3]
    for fold in folds:
        assert fold["train_start"] == day(0) and fold["train_end"] < fold["valid_start"]
    assert [f["valid_start"] for f in folds] == [day(59), day(66), day(73)]
    assert folds[-1]["valid_end"] == day(79)
    assert rows(V.make_time_splits(dated.orderBy(F.rand(3)), "sales_date", 3, 7)) == folds


def test_gap(dated):
    folds = rows(V.make_time_series_folds(dated, 7, 3, gap=5))
    assert folds[0]["train_end"] == day(53) and folds[0]["valid_start"] == day(59)
    with pytest.raises(Exception, match="dates are needed"):
        V.make_time_series_folds(dated, 7, 3, gap=60).collect()


def test_split_errors(dated):
    for n, h in ((0, 7), (3, 0)):
        with pytest.raises(ValueError):
            V.make_time_splits(dated, "sales_date", n, h)
    with pytest.raises(Exception, match="81 dates are needed"):
        V.make_time_splits(dated, "sales_date", 8, 10).collect()
    assert V.make_time_splits(dated, "sales_date", 79, 1).count() == 79


def test_fold_members(dated):
    folds = V.make_time_splits(dated, "sales_date", 3, 7)
    assigned = V.assign_folds(dated, folds)
    for fold in folds.collect():
        train, valid = V.split_by_fold(dated, fold)
        for role, side in (("train", train), ("valid", valid)):
            members = assigned.where((F.col("split") == fold["split"]) & (F.col("role") == role))
            assert {r["value"] for r in members.collect()} == {r["value"] for r in side.collect()}
