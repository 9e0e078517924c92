from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.operators import baselines as B
from shelfline.operators import features as X
from shelfline.sources import io
from tests.conftest import by_key, day

KEYS = ["sales_date", "stock_code", "market_id"]


def at(df, n, market="UK", stock="A"):
    return by_key(df, *KEYS)[(day(n), stock, market)]


def test_lags_stay_in_their_series(daily):
    df = X.add_lag_features(daily)
    assert at(df, 7)["lag_7"] == 1.0 and at(df, 7, "FR")["lag_7"] == 101.0
    assert at(df, 6)["lag_7"] is None and at(df, 7)["invoices_cnt_lag_7"] == 0


def test_rolling_uses_past_rows_only(daily):
    df = X.add_rolling_features(daily)
    assert at(df, 0)["rolling_mean_7"] is None and at(df, 2)["rolling_mean_7"] == 1.5
    assert at(df, 1)["rolling_std_28"] is None and at(df, 2)["rolling_std_28"] == pytest.approx(0.5**0.5)
    assert at(df, 4)["rolling_median_28"] == 2.5


def test_price_change(daily):
    row = at(X.add_price_features(daily), 7)
    assert row["avg_unit_price_lag_7"] == 10.0 and row["price_change_abs"] == 2.0
    assert row["price_change_pct"] == pytest.approx(0.2)


def test_price_change_from_zero(daily):
    df = daily.withColumn("avg_unit_price", F.lit(0.0))
    assert at(X.add_price_features(df), 7)["price_change_pct"] is None


def test_calendar(daily):
    row = at(X.add_calendar_features(daily), 5)  # 2024-01-06, a Saturday
    assert (row["weekday"], row["month"], row["year"], row["is_weekend"]) == (5, 1, 2024, 1)


def test_pauses(spark, daily):
    quantities = [0.0, -1.0, 3.0, None, 0.0, 2.0]
    data = [(day(2 * i), "A", "UK", q, 1.0, 1, 1, 1.0) for i, q in enumerate(quantities)]
    got = by_key(X.add_zero_sales_features(spark.createDataFrame(data, daily.schema)), "sales_date")
    rows = [got[(day(2 * i),)] for i in range(6)]
    assert [r["zero_sales_streak"] for r in rows] == [0, 1, 2, 0, 1, 2]
    assert [r["days_since_last_sale"] for r in rows] == [None, None, None, 2, 4, 6]


def test_missing_columns(daily):
    with pytest.raises(ValueError, match="avg_unit_price"):
        X.feature_matrix(daily.drop("avg_unit_price"))
    with pytest.raises(ValueError, match="market_id"):
        B.add_baselines(daily.drop("market_id"))


def test_matrix_matches_single_steps(daily):
    whole = X.feature_matrix(daily)
    steps = X.add_calendar_features(daily)
    for add in (X.add_lag_features, X.add_rolling_features, X.add_price_features, X.add_zero_sales_features):
        steps = add(steps)
    assert by_key(whole, *KEYS) == {
        k: {c: v[c] for c in whole.columns} for k, v in by_key(steps, *KEYS).items()
    }


def test_no_future_leak(daily):
    cut = F.col("sales_date") <= day(6)
    changed = daily.withColumn("net_sales_qty", F.when(cut, F.col("net_sales_qty")).otherwise(-1e9))
    same = X.feature_view(daily).where(cut).drop("net_sales_qty")
    other = X.feature_view(changed).where(cut).drop("net_sales_qty")
    assert by_key(same, *KEYS) == by_key(other, *KEYS)


def test_row_order_does_not_matter(daily):
    shuffled = daily.orderBy(F.rand(1))
    assert by_key(X.feature_view(shuffled), *KEYS) == by_key(X.feature_view(daily), *KEYS)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_share_one_shuffle(daily, sales):
    assert plan_of(X.feature_view(daily)).count("Exchange") == 1
    assert plan_of(B.add_baselines(sales)).count("Exchange") == 1


def test_bucketed_table_needs_no_shuffle(spark, daily):
    table = io.write_bucketed(daily, "bucketed_daily", 4)
    conf = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    assert spark.conf.get(conf) == "true"
    assert "Exchange" not in plan_of(X.feature_view(table))
    assert by_key(X.feature_view(table), *KEYS) == by_key(X.feature_view(daily), *KEYS)


def test_baseline_values(sales):
    df = B.add_baselines(sales)
    assert df.count() == 70
    assert at(df, 7)["seasonal_naive_7"] == 1.0 and at(df, 8)["seasonal_naive_7"] == 2.0
    assert at(df, 0)["moving_average_7"] is None
    assert at(df, 3)["moving_average_7"] == 2.0 and at(df, 7)["moving_average_7"] == 4.0
    assert at(df, 7)["median_by_weekday"] == 1.0 and at(df, 14)["median_by_weekday"] == 4.5
    assert at(df, 28)["seasonal_naive_28"] == 1.0 and at(df, 1)["naive_last_value"] == 1.0
    assert at(df, 34, stock="B")["moving_average_28"] == pytest.approx(205.0)


def test_generic_helpers(sales):
    df = B.add_moving_average(B.add_seasonal_naive(sales, 3), 2)
    assert at(df, 3)["seasonal_naive"] == 1.0 and at(df, 3)["moving_average"] == 2.5
    dated = sales.withColumnRenamed("sales_date", "date").withColumnRenamed("market_id", "m")
    got = X.add_lag_rolling_features(dated, ["stock_code", "m"], lags=(2,), windows=(4,))
    assert got.columns[-2:] == ["lag_2", "rolling_mean_4"]


@pytest.mark.parametrize("run_rows", [5, 16, 33])
def test_split_groups_equal_whole_groups(spark, run_rows):
    """One group holds most rows, many of them on one date; splitting must not show."""
    data = [(day(i % 40), "hot", float((i * 37) % 101)) for i in range(300)]
    data += [(day(7), "hot", float(i % 5)) for i in range(60)]
    data += [(day(i), f"g{i % 3}", float(i)) for i in range(20)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "date date, g string, v double, id int")

    def run(limit):
        out = X.add_lag_rolling_features(df, ["g"], "v", lags=(1, 4), windows=(3, 5), run_rows=limit)
        return by_key(out, "id")

    whole, split = run(10_000), run(run_rows)
    assert len(split) == len(data)
    for key, row in whole.items():
        assert split[key] == pytest.approx(row)


def test_baseline_metrics(sales):
    table = B.baseline_metrics(B.add_baselines(sales))
    assert table.count() == 36
    got = by_key(table, "baseline", "metric")
    assert got[("naive_last_value", "mae")]["value"] == pytest.approx((34 * 1 + 34 * 10) / 68)
    common = by_key(B.baseline_metrics(B.add_baselines(sales), common_rows=True), "baseline", "metric")
    assert common[("seasonal_naive_28", "mae")] == got[("seasonal_naive_28", "mae")]
    assert B.best_baseline(table).first()["baseline"] == "naive_last_value"


def test_scores_by_fold_are_those_of_the_copied_rows(spark, sales):
    from shelfline.operators import validation as V

    rows = B.add_baselines(sales)
    folds = V.make_time_splits(sales, "sales_date", 3, 5)
    got = {tuple(r[:4]): r["value"] for r in B.baseline_metrics_by_fold(rows, folds).collect()}
    assert len(got) == 3 * 2 * 6 * 6
    copied = V.assign_folds(rows, folds).cache()
    for split, role in ((1, "train"), (2, "valid"), (3, "valid")):
        own = copied.where((F.col("split") == split) & (F.col("role") == role))
        for r in B.baseline_metrics(own).collect():
            assert got[(split, role, r["baseline"], r["metric"])] == pytest.approx(r["value"])
    plan = B.baseline_metrics_by_fold(rows, folds)._jdf.queryExecution().optimizedPlan().toString()
    # Rows are summed per date before anything is copied.
    assert plan.index("Generate") < plan.rindex("Aggregate [sales_date")
