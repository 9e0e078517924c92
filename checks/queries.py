"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import metrics as E
from shelfline.functions import stock
from shelfline.functions.columns import moment, number
from shelfline.operators import baselines as B
from shelfline.operators import dashboard as D
from shelfline.operators import features as X
from shelfline.operators import inventory as I
from shelfline.operators import mart as M
from shelfline.operators import model as L
from shelfline.operators import quality as Q
from shelfline.operators import reports as R
from shelfline.operators import segments as G
from shelfline.operators import validation as V
from shelfline.plans.stages import baseline_forecast, dashboard_from_mart, publish, sql_stages
from shelfline.schema import (
    DATE,
    FACT_SCHEMA,
    FORECAST,
    MART_KEYS,
    MONTH,
    SERIES_KEYS,
    TARGET,
    conform,
    normalize_column_names,
    normalize_dashboard_columns,
)
from shelfline.session import hand_over, scratch_path
from shelfline.sources import fixtures as src
from shelfline.sources import io
from shelfline.sources.monthly import hand_over_months, refresh_mart, write_months

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEAR = 365
FORECAST_HEADERS = ["Date", "Stock-Code", "Market ID", "Actual Qty", "Model Forecast"]
SOURCES = {"model": "moving_average_28", "naive": "naive_last_value"}


def rounded(df: DataFrame) -> DataFrame:
    """Six decimals, so that summation order does not show."""
    return df.select(
        *(
            (F.round(f.name, 6) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        )
    )


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: rounded(fn(spark, folder))
    return fn


# Inputs ---------------------------------------------------------------------------------


def fact(spark, folder):
    return M.prepare_transactions(src.transactions(spark, folder))


def mart(spark, folder):
    """The mart of stored facts: its parts are read apart."""
    return M.daily_sales_mart(hand_over(fact(spark, folder), "facts"))


def daily(spark, folder):
    """The mart without texts and distinct counts."""
    return M.daily_sums(fact(spark, folder))


def sales_table(spark, folder):
    """Target and revenue of the mart as a stored table, for queries that read it repeatedly."""
    sums = M.daily_sums(fact(spark, folder))
    return hand_over(sums.select(*MART_KEYS, TARGET, "revenue"), "sales")


def mart_days(spark, folder):
    """Rows that hold the mart's dates, without building the mart."""
    return M.with_mart_keys(fact(spark, folder))


def raw(spark, folder):
    return normalize_column_names(src.raw_transactions(spark, folder))


def stored_raw(spark, folder):
    """The raw rows as a stored table: a summary scans every column by itself, and a scan of the
    unstored rows would take all their joins."""
    return hand_over(raw(spark, folder), "raw")


def forecast(spark, folder, days=YEAR):
    return baseline_forecast(sales_table(spark, folder), holdout_days=days)


def all_baselines(spark, folder, days=YEAR):
    """Mart rows of the last dates with all baselines as columns."""
    rows = sales_table(spark, folder).select(*MART_KEYS, TARGET)
    return V.train_holdout_split(B.add_baselines(rows), DATE, days)[1]


def policy(spark, folder, days=YEAR):
    return I.inventory_policy(forecast(spark, folder, days), require_rows=False)


def segments(spark, folder):
    return G.abc_xyz_segments(daily(spark, folder))


def typed_text(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "quantity": number(df, "quantity"),
            "unit_price": number(df, "unit_price"),
            "invoice_date": moment(df, "invoice_date"),
        }
    )


def exported(df: DataFrame) -> DataFrame:
    return df.toDF(*FORECAST_HEADERS)


# Sources and schema ---------------------------------------------------------------------


@query
def read_transactions(spark, folder):
    path = scratch_path(spark, "transactions") + ".csv"
    io.write_table(src.raw_transactions(spark, folder), path, "csv")
    return typed_text(io.read_transactions(spark, path))


@query
def normalize_column_names_(spark, folder):
    return typed_text(raw(spark, folder))


@query
def normalize_dashboard_columns_(spark, folder):
    return normalize_dashboard_columns(exported(forecast(spark, folder, 28)))


@query
def read_source(spark, folder):
    path = scratch_path(spark, "forecast") + ".csv"
    io.write_table(exported(forecast(spark, folder)), path, "csv")
    rows = io.read_source(spark, path, D.FORECAST_COLUMNS)
    return rows.withColumns(
        {DATE: F.col(DATE).try_cast("date")}
        | {c: number(rows, c) for c in ("actual_sales", "forecast_sales")}
    )


@query
def transactions_schema(spark, folder):
    texts = fact(spark, folder)
    return conform(texts.select(*(F.col(c).cast("string") for c in texts.columns)), FACT_SCHEMA)


@query
def dim_date(spark, folder):
    return M.dim_date(fact(spark, folder))


@query
def dim_product(spark, folder):
    return M.dim_product(fact(spark, folder))


@query
def dim_market(spark, folder):
    return M.dim_market(fact(spark, folder))


@query
def write_forecast(spark, folder):
    path = scratch_path(spark, "predictions") + ".parquet"
    io.write_forecast(forecast(spark, folder, 28), path)
    return spark.read.parquet(path)


# Quality --------------------------------------------------------------------------------


def _register_check(name: str, check: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: rounded(Q.long_report(check(raw(spark, folder))))


for _name in (
    "check_required_columns",
    "check_negative_prices",
    "check_duplicate_rows",
    "check_missing_invoice_date",
    "check_missing_stock_code",
    "check_missing_prices_share",
    "check_returns_share",
    "run_all_data_checks",
):
    _register_check(_name, getattr(Q, _name))


@query
def data_quality_summary(spark, folder):
    return Q.data_quality_summary(stored_raw(spark, folder)).drop("dtype")


@query
def data_quality_sketches(spark, folder):
    """The summary from one sketch per column and day, and whether it is near the exact one."""
    rows = stored_raw(spark, folder)
    day = F.to_date(moment(rows, "invoice_date")).alias("day")
    stored = hand_over(Q.column_sketches(rows, [day]), "sketches")
    about = Q.summary_of_sketches(stored, rows.schema)
    exact = Q.data_quality_summary(rows).select("column", F.col("unique_count").alias("exact"))
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 0.05 * F.col("exact")
    return about.join(exact, "column").select(
        "column", "missing_count", "missing_share", near.alias("unique_count_is_near")
    )


# Mart -----------------------------------------------------------------------------------


@query
def prepare_transactions(spark, folder):
    return fact(spark, folder)


@query
def mart_daily_sales(spark, folder):
    return mart(spark, folder)


@query
def mart_refreshed(spark, folder):
    """The mart after late and new rows came in: only their months are computed again."""
    facts = hand_over(fact(spark, folder), "facts")
    late = F.col(DATE).between("1995-03-10", "1995-03-20") | (F.col(DATE) >= "1998-05-01")
    late = F.coalesce(late, F.lit(False))
    facts_path, mart_path = scratch_path(spark, "facts"), scratch_path(spark, "mart")
    write_months(M.daily_sales_mart(write_months(facts.where(~late), facts_path)), mart_path)
    return refresh_mart(spark, facts_path, mart_path, facts.where(late)).drop(MONTH)


# Features -------------------------------------------------------------------------------


def _register_feature(name: str, build: Callable[[DataFrame], DataFrame], added: list[str]) -> None:
    def run(spark, folder):
        return rounded(build(mart(spark, folder)).select(*MART_KEYS, TARGET, *added))

    QUERIES[name] = run


_register_feature(
    "lag_features",
    X.add_lag_features,
    ["lag_7", "lag_14", "lag_28", "invoices_cnt_lag_7", "customers_cnt_lag_7"],
)
_register_feature(
    "rolling_features",
    X.add_rolling_features,
    ["rolling_mean_7", "rolling_mean_28", "rolling_std_28", "rolling_median_28"],
)
_register_feature("rolling_mean", X.add_rolling_features, ["rolling_mean_7", "rolling_mean_28"])
_register_feature("rolling_std_28", X.add_rolling_features, ["rolling_std_28"])
_register_feature("rolling_median_28", X.add_rolling_features, ["rolling_median_28"])
_register_feature(
    "price_features",
    X.add_price_features,
    ["avg_unit_price_lag_7", "price_change_abs", "price_change_pct"],
)
_register_feature(
    "calendar_features", X.add_calendar_features, ["weekday", "month", "year", "is_weekend"]
)
_register_feature("days_since_last_sale", X.add_zero_sales_features, ["days_since_last_sale"])
_register_feature("zero_sales_streak", X.add_zero_sales_features, ["zero_sales_streak"])


@query
def feature_view(spark, folder):
    return X.feature_view(mart(spark, folder))


@query
def feature_matrix(spark, folder):
    return X.feature_matrix(mart(spark, folder))


@query
def feature_view_dense(spark, folder):
    return X.feature_view(src.dense_sales(spark, folder))


def market_days(spark, folder):
    days = mart(spark, folder).groupBy("market_id", F.col(DATE).alias("date"))
    return hand_over(days.agg(F.sum(TARGET).alias("sales")), "market-days")


@query
def lag_rolling_generic(spark, folder):
    return X.add_lag_rolling_features(
        market_days(spark, folder), ["market_id"], "sales", lags=(1, 7), windows=(3, 14)
    )


@query
def lag_rolling_split_groups(spark, folder):
    """The same, cut into many short runs."""
    return X.add_lag_rolling_features(
        market_days(spark, folder), ["market_id"], "sales", lags=(1, 7), windows=(3, 14), run_rows=1000
    )


# Baselines ------------------------------------------------------------------------------


def _register_baseline(name: str) -> None:
    def run(spark, folder):
        rows = daily(spark, folder).select(*MART_KEYS, TARGET)
        return rounded(B.add_baselines(rows, [name]))

    QUERIES[name] = run


for _name in B.BASELINES:
    _register_baseline(_name)


@query
def baselines_all(spark, folder):
    return B.add_baselines(daily(spark, folder).select(*MART_KEYS, TARGET))


@query
def seasonal_naive(spark, folder):
    return B.add_seasonal_naive(daily(spark, folder).select(*MART_KEYS, TARGET), 14)


@query
def moving_average_forecast(spark, folder):
    return B.add_moving_average(daily(spark, folder).select(*MART_KEYS, TARGET), 5)


@query
def baseline_metrics(spark, folder):
    return B.baseline_metrics(all_baselines(spark, folder))


@query
def baseline_metrics_common_rows(spark, folder):
    return B.baseline_metrics(all_baselines(spark, folder), common_rows=True)


@query
def best_baseline(spark, folder):
    return B.best_baseline(B.baseline_metrics(all_baselines(spark, folder)))


# Validation -----------------------------------------------------------------------------


@query
def train_holdout_split(spark, folder):
    return V.label_holdout(sales_table(spark, folder).select(*MART_KEYS, TARGET), DATE, 28)


@query
def train_holdout_by_month(spark, folder):
    """The split of a table stored by month: its cutoff, found at run time, prunes folders."""
    stored = hand_over_months(sales_table(spark, folder).select(*MART_KEYS, TARGET), "sales-by-month")
    sides = dict(zip(("train", "holdout"), V.train_holdout_split(stored, DATE, 28)))
    train, holdout = (df.drop(MONTH).withColumn("role", F.lit(role)) for role, df in sides.items())
    return train.unionByName(holdout)


@query
def make_time_splits(spark, folder):
    return V.make_time_splits(mart_days(spark, folder), DATE, 3, 28)


@query
def make_time_series_folds(spark, folder):
    return V.make_time_series_folds(mart_days(spark, folder), 28, 4, gap=7)


@query
def split_by_fold(spark, folder):
    rows = daily(spark, folder).select(*MART_KEYS, TARGET)
    fold = V.make_time_splits(mart_days(spark, folder), DATE, 3, 28).where("split = 2").first()
    train, valid = V.split_by_fold(rows, fold)
    return train.withColumn("role", F.lit("train")).unionByName(
        valid.withColumn("role", F.lit("valid"))
    )


@query
def assign_folds(spark, folder):
    rows = daily(spark, folder).select(*MART_KEYS, TARGET)
    return V.assign_folds(rows, V.make_time_splits(mart_days(spark, folder), DATE, 3, 28))


@query
def baseline_metrics_by_fold(spark, folder):
    rows = B.add_baselines(sales_table(spark, folder).select(*MART_KEYS, TARGET))
    return B.baseline_metrics_by_fold(rows, V.make_time_splits(mart_days(spark, folder), DATE, 3, 28))


# Metrics --------------------------------------------------------------------------------


def _register_metric(name: str, metric) -> None:
    def run(spark, folder):
        value = metric(F.col(TARGET), F.col(FORECAST)).alias(name)
        return rounded(forecast(spark, folder).groupBy("market_id").agg(value))

    QUERIES[name] = run


for _name in ("mae", "rmse", "wmape", "forecast_bias", "service_level_proxy", "stockout_risk_rate"):
    _register_metric(_name, getattr(E, _name))


@query
def stockout_risk_rate_threshold(spark, folder):
    value = E.stockout_risk_rate(F.col(TARGET), F.col(FORECAST), 10.0)
    return forecast(spark, folder).groupBy("market_id").agg(value.alias("stockout_risk_rate"))


@query
def metrics_table(spark, folder):
    return E.metrics_table(forecast(spark, folder), TARGET, FORECAST)


@query
def evaluate(spark, folder):
    return E.evaluate(forecast(spark, folder), TARGET, FORECAST)


# Segments -------------------------------------------------------------------------------


@query
def segment_stats(spark, folder):
    return G.segment_stats(daily(spark, folder))


@query
def abc_segment(spark, folder):
    stats = G.segment_stats(daily(spark, folder)).select(*SERIES_KEYS, "revenue")
    return G.add_abc_segment(stats)


@query
def xyz_segment(spark, folder):
    return G.add_xyz_segment(G.segment_stats(daily(spark, folder)))


@query
def abc_xyz_segments(spark, folder):
    return segments(spark, folder)


@query
def abc_xyz_compat(spark, folder):
    renamed = daily(spark, folder).withColumnsRenamed({TARGET: "sales", "market_id": "country"})
    return G.abc_xyz_from_sales(renamed)


# Model ----------------------------------------------------------------------------------


def model_features(spark, folder):
    return hand_over(X.feature_matrix(mart(spark, folder)), "features")


@query
def feature_columns(spark, folder):
    """Rows in which each model feature has a value."""
    rows = X.feature_matrix(mart(spark, folder))
    names = L.feature_columns(rows)
    known = rows.agg(*(F.count(c).alias(c) for c in names))
    return known.unpivot([], names, "feature", "known_rows")


@query
def prepare_train_test(spark, folder):
    train, test, names = L.prepare_train_test(model_features(spark, folder))
    sides = {"train": train, "holdout": test}
    labelled = [df.withColumn("role", F.lit(role)) for role, df in sides.items()]
    columns = [*MART_KEYS, TARGET, *names, "role"]
    return labelled[0].unionByName(labelled[1]).select(*columns)


# Half of the library's default: a round of a tree costs a job, however small the table.
MODEL_TREES = 100
_runs: dict[tuple[str, str], dict[str, object]] = {}


def modeling(spark, folder):
    """One training run per session and folder serves all model queries."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _runs:
        # The mart and the baselines' sales come from facts that are stored once.
        facts = hand_over(fact(spark, folder), "facts")
        sales = hand_over(M.daily_sums(facts).select(*MART_KEYS, TARGET), "sales")
        late = V.train_holdout_split(B.add_baselines(sales), DATE, YEAR)[1]
        baselines = B.baseline_metrics(late)
        features = X.feature_matrix(M.daily_sales_mart(facts))
        _runs[key] = L.run_modeling(features, baselines, YEAR, MODEL_TREES)
    return _runs[key]


@query
def predict_non_negative(spark, folder):
    """Every holdout row, and whether its forecast is a number of at least zero."""
    usable = F.coalesce((F.col(FORECAST) >= 0) & ~F.isnan(FORECAST), F.lit(False))
    return modeling(spark, folder)["forecast"].select(*MART_KEYS, TARGET, usable.alias("usable"))


@query
def model_forecast(spark, folder):
    return modeling(spark, folder)["forecast"].select(*MART_KEYS, TARGET, FORECAST)


@query
def evaluate_model(spark, folder):
    """The holdout's size and what must hold between the metrics."""
    run = modeling(spark, folder)
    rows = run["forecast"].agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.abs(TARGET)).alias("actual")
    )
    near = F.abs(F.col("mae") * F.col("rows") - F.col("wmape") * F.col("actual"))
    rates = F.col("service_level_proxy") + F.col("stockout_risk_rate")
    return rows.join(F.broadcast(run["metrics"].limit(1)), F.lit(True)).select(
        "rows",
        "actual",
        (F.col("mae") <= F.col("rmse")).alias("mae_within_rmse"),
        (near <= 1e-6 * F.col("actual")).alias("wmape_is_mae_share"),
        (F.abs(rates - 1) < 1e-9).alias("rates_add_up"),
    )


@query
def model_metrics(spark, folder):
    return modeling(spark, folder)["metrics"]


@query
def compare_with_best_baseline(spark, folder):
    """The comparison, without the model's own value."""
    value = F.when(F.col("source") != "model", F.col("value"))
    return modeling(spark, folder)["comparison"].select(
        "source", "metric", (F.col("value") > 0).alias("positive"), value.alias("baseline_value")
    )


@query
def model_comparison(spark, folder):
    return modeling(spark, folder)["comparison"]


@query
def compare_baseline_with_best(spark, folder):
    """The comparison with a baseline standing in for the model."""
    rows = hand_over(all_baselines(spark, folder), "baselines")
    own = E.evaluate(rows, TARGET, "moving_average_28")
    return L.compare_with_best_baseline(own, B.baseline_metrics(rows))


def known_rows(run, spark, folder):
    """Rows in which each model feature has a value."""
    rows = X.feature_matrix(mart(spark, folder))
    known = rows.agg(*(F.count(c).alias(c) for c in run["feature_columns"]))
    return known.unpivot([], run["feature_columns"], "feature", "known_rows")


@query
def feature_importance(spark, folder):
    """The features, and whether their gains add up to one."""
    run = modeling(spark, folder)
    gains = run["feature_importance"]
    whole = gains.agg(F.abs(F.sum("importance") - 1) < 1e-6).scalar()
    return (
        gains.join(known_rows(run, spark, folder), "feature")
        .select("feature", "known_rows", whole.alias("sums_to_one"))
    )


@query
def model_importance(spark, folder):
    return modeling(spark, folder)["feature_importance"]


@query
def feature_split_counts(spark, folder):
    """The features, and whether any of them was split on."""
    run = modeling(spark, folder)
    splits = L.split_counts(run["model"], run["forecast"])
    some = splits.agg(F.sum("importance") > 0).scalar()
    return (
        splits.join(known_rows(run, spark, folder), "feature")
        .select("feature", "known_rows", some.alias("any_split"))
    )


@query
def model_split_counts(spark, folder):
    run = modeling(spark, folder)
    return L.split_counts(run["model"], run["forecast"])


@query
def modeling_run(spark, folder):
    """Rows and actual sums per day of the modelled holdout."""
    return modeling(spark, folder)["forecast"].groupBy(DATE).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(TARGET).alias("actual_sales"),
        (F.min(FORECAST) >= 0).alias("forecast_not_negative"),
    )


@query
def model_daily(spark, folder):
    """Daily actual and forecast sums of the modelled holdout."""
    return R.daily_actual_vs_forecast(modeling(spark, folder)["forecast"])


# Inventory ------------------------------------------------------------------------------


@query
def safety_stock(spark, folder):
    return policy(spark, folder).select(
        *SERIES_KEYS, stock.safety_stock(F.col("demand_std"), 9, 1.5).alias("safety_stock")
    )


@query
def reorder_point(spark, folder):
    safety = stock.safety_stock(F.col("demand_std"), 9, 1.5)
    return policy(spark, folder).select(
        *SERIES_KEYS, stock.reorder_point(F.col("avg_daily_demand"), 9, safety).alias("reorder_point")
    )


@query
def stockout_risk_proxy(spark, folder):
    actual, predicted = F.col(TARGET), F.col(FORECAST)
    available = stock.demand(predicted) * 0.5
    return forecast(spark, folder).select(
        *MART_KEYS, stock.stockout_risk(actual, predicted, available).alias("stockout_risk")
    )


@query
def excess_stock_proxy(spark, folder):
    return forecast(spark, folder).select(
        *MART_KEYS, stock.excess_stock(F.col(FORECAST), F.col(TARGET)).alias("excess_stock")
    )


@query
def inventory_metrics(spark, folder):
    return I.inventory_metrics(forecast(spark, folder))


@query
def inventory_metrics_28(spark, folder):
    return I.inventory_metrics(forecast(spark, folder, 28))


@query
def inventory_policy_table(spark, folder):
    return I.inventory_policy_table(forecast(spark, folder), require_rows=False)


@query
def inventory_policy_half_stock(spark, folder):
    return I.inventory_policy_table(forecast(spark, folder), 14, 2.05, 0.5, require_rows=False)


@query
def service_level_z(spark, folder):
    """Stock levels by service level, one of which has no z-score of its own."""
    levels = F.explode(F.array(*(F.lit(x) for x in (0.9, 0.95, 0.98, 0.99)))).alias("service_level")
    rows = policy(spark, folder).select(*SERIES_KEYS, "avg_daily_demand", "demand_std", levels)
    mean, std, level = F.col("avg_daily_demand"), F.col("demand_std"), F.col("service_level")
    return rows.select(
        *SERIES_KEYS,
        "service_level",
        stock.service_level_z(level).alias("z_score"),
        stock.safety_stock_at(std, 7, level).alias("safety_stock"),
        stock.reorder_point_at(mean, std, 7, level).alias("reorder_point"),
    )


@query
def risk_table_by_source(spark, folder):
    return I.risk_table_by_source(all_baselines(spark, folder), SOURCES)


@query
def top_stockout_products(spark, folder):
    return I.top_stockout_products(policy(spark, folder))


@query
def top_overstock_products(spark, folder):
    return I.top_overstock_products(policy(spark, folder))


@query
def scenario_grid(spark, folder):
    return I.scenario_grid(policy(spark, folder), [3, 7, 14], [0.9, 0.95, 0.98])


@query
def risk_summary(spark, folder):
    return I.risk_summary(policy(spark, folder))


# Dashboard ------------------------------------------------------------------------------


def dashboard_rows(spark, folder, days=YEAR):
    return normalize_dashboard_columns(forecast(spark, folder, days))


def dashboard(spark, folder):
    rows = sales_table(spark, folder)
    return dashboard_from_mart(rows, hand_over(baseline_forecast(rows, holdout_days=YEAR), "forecast"))


@query
def group_metrics(spark, folder):
    return D.group_metrics(dashboard_rows(spark, folder))


@query
def choose_inventory_source(spark, folder):
    table = I.risk_table_by_source(all_baselines(spark, folder), SOURCES)
    return D.choose_inventory_source(hand_over(table, "risk"))


@query
def row_errors(spark, folder):
    return D.row_errors(dashboard_rows(spark, folder))


@query
def dashboard_dataset(spark, folder):
    return dashboard(spark, folder)


@query
def published_dashboard(spark, folder):
    """The dashboard as a run writes it, read again."""
    rows = sales_table(spark, folder)
    late = hand_over(baseline_forecast(rows, holdout_days=YEAR), "forecast")
    paths = publish(rows, late, scratch_path(spark, "published"))
    return spark.read.parquet(next(path for path in paths if path.endswith("/dashboard.parquet")))


@query
def dashboard_by_source(spark, folder):
    """The dashboard with its stock columns taken from the table of all sources."""
    rows = sales_table(spark, folder)
    late = V.train_holdout_split(B.add_baselines(rows, list(SOURCES.values())), DATE, YEAR)[1]
    scored = hand_over(late.select(*MART_KEYS, TARGET, *SOURCES.values()), "baselines")
    table = hand_over(I.risk_table_by_source(scored, SOURCES), "risk")
    predicted = scored.withColumnRenamed(SOURCES["model"], FORECAST).dropna(subset=[FORECAST])
    predicted = predicted.select(*MART_KEYS, TARGET, FORECAST)
    return D.dashboard_dataset(predicted, G.abc_xyz_segments(rows), table, require_rows=False)


@query
def sales_overview(spark, folder):
    return R.sales_overview(fact(spark, folder))


@query
def error_by_market(spark, folder):
    return R.error_by_market(forecast(spark, folder))


@query
def error_by_segment(spark, folder):
    rows = sales_table(spark, folder)
    return R.error_by_segment(baseline_forecast(rows, holdout_days=YEAR), G.abc_xyz_segments(rows))


@query
def error_by_product(spark, folder):
    return R.error_by_product(forecast(spark, folder))


@query
def daily_actual_vs_forecast(spark, folder):
    return R.daily_actual_vs_forecast(forecast(spark, folder))


@query
def abc_xyz_matrix(spark, folder):
    return R.abc_xyz_matrix(segments(spark, folder))


@query
def risk_matrix(spark, folder):
    rows = sales_table(spark, folder)
    risks = I.inventory_metrics(baseline_forecast(rows, holdout_days=YEAR))
    return R.risk_matrix(risks, G.abc_xyz_segments(rows))


@query
def model_vs_baseline_by_segment(spark, folder):
    rows = sales_table(spark, folder)
    late = V.train_holdout_split(B.add_baselines(rows, list(SOURCES.values())), DATE, YEAR)[1]
    return R.forecasts_by_segment(late, G.abc_xyz_segments(rows), SOURCES)


@query
def revenue_vs_error(spark, folder):
    rows = sales_table(spark, folder)
    errors = D.group_metrics(normalize_dashboard_columns(baseline_forecast(rows, holdout_days=YEAR)))
    return R.revenue_vs_error(G.segment_stats(rows), errors)


@query
def top_revenue_products(spark, folder):
    return R.top_revenue_products(daily(spark, folder), 10)


@query
def dashboard_filters(spark, folder):
    return D.filter_dashboard(
        dashboard(spark, folder),
        period=("2001-01-01", "2001-12-31"),
        markets=["NATION_1", "NATION_2", "NATION_3"],
        abc=["A", "B"],
        abs_error=(5.0, 50.0),
    )


@query
def sql_chain(spark, folder):
    """SQL over the registered stages, joined back to the last one."""
    sql_stages(src.transactions(spark, folder), YEAR)
    return spark.sql(
        "SELECT f.stock_code, f.market_id, COUNT(*) AS rows_cnt, MAX(f.zero_sales_streak) AS streak, "
        "MAX(i.suggested_reorder_point) AS reorder_point "
        "FROM features_lags_rolling f JOIN inventory_metrics i USING (stock_code, market_id) "
        "GROUP BY f.stock_code, f.market_id"
    )


for _alias in ("normalize_column_names_", "normalize_dashboard_columns_"):
    QUERIES[_alias.rstrip("_")] = QUERIES.pop(_alias)
