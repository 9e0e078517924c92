"""Scenario inventory policy per product and market.

There is no stock on hand in the data: every risk is a scenario over actuals and forecasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import number
from shelfline.functions.metrics import forecast_bias, wmape
from shelfline.functions.stock import (
    LEAD_TIME_DAYS,
    Z_SCORE,
    demand,
    excess_stock,
    reorder_point,
    safety_stock,
    service_level_z,
    stockout_risk,
)
from shelfline.schema import DATE, FORECAST, SERIES_KEYS, TARGET, require_columns

# Column names and their order.
METRIC_COLUMNS = [
    *SERIES_KEYS,
    "avg_daily_demand",
    "demand_std",
    "forecast_error",
    "forecast_bias",
    "stockout_risk_flag",
    "overstock_risk_flag",
    "suggested_reorder_point",
    "suggested_safety_stock",
]

# Column names and their order.
POLICY_COLUMNS = [
    *SERIES_KEYS,
    "observed_days",
    "avg_daily_demand",
    "demand_std",
    "avg_forecast_sales",
    "forecast_error",
    "forecast_bias",
    "stockout_risk_rate",
    "overstock_risk_rate",
    "stockout_risk_flag",
    "overstock_risk_flag",
    "negative_actual_sales_count",
    "lead_time_days",
    "z_score",
    "available_stock_assumption",
    "suggested_safety_stock",
    "suggested_reorder_point",
]


def _forecast_rows(df: DataFrame, *extra: str) -> DataFrame:
    """Complete rows with demand clipped at zero."""
    require_columns(df, [DATE, *SERIES_KEYS, TARGET, FORECAST, *extra], "forecast rows")
    rows = df.select(
        *extra,
        *SERIES_KEYS,
        F.col(DATE).try_cast("date").alias(DATE),
        number(df, TARGET).alias(TARGET),
        number(df, FORECAST).alias(FORECAST),
    ).dropna()
    return rows.withColumns(
        {"_actual": demand(F.col(TARGET)), "_forecast": demand(F.col(FORECAST))}
    )


def _policy(
    rows: DataFrame, keys: list[str], lead_time_days: int, z_score: float, multiplier: float
) -> DataFrame:
    if multiplier < 0:
        raise ValueError("available_stock_multiplier must not be negative")
    actual, forecast = F.col("_actual"), F.col("_forecast")
    available = forecast * multiplier
    short, excess = stockout_risk(actual, forecast, available), excess_stock(forecast, actual)

    def rate(flag: Column) -> Column:
        return F.avg(flag.cast("double"))

    groups = rows.groupBy(*keys).agg(
        F.count_distinct(DATE).alias("observed_days"),
        F.avg(actual).alias("avg_daily_demand"),
        F.coalesce(F.stddev_samp(actual), F.lit(0.0)).alias("demand_std"),
        F.avg(forecast).alias("avg_forecast_sales"),
        wmape(actual, forecast).alias("forecast_error"),
        forecast_bias(actual, forecast).alias("forecast_bias"),
        rate(short).alias("stockout_risk_rate"),
        rate(excess).alias("overstock_risk_rate"),
        F.bool_or(short).alias("stockout_risk_flag"),
        F.bool_or(excess).alias("overstock_risk_flag"),
        F.count_if(F.col(TARGET) < 0).alias("negative_actual_sales_count"),
        F.avg(available).alias("available_stock_assumption"),
    )
    safety = safety_stock(F.col("demand_std"), lead_time_days, z_score)
    reorder = reorder_point(F.col("avg_daily_demand"), lead_time_days, F.col("suggested_safety_stock"))
    return (
        groups.withColumns(
            {
                "lead_time_days": F.lit(lead_time_days),
                "z_score": F.lit(z_score),
                "suggested_safety_stock": safety,
            }
        )
        .withColumn("suggested_reorder_point", reorder)
    )


def inventory_metrics(df: DataFrame) -> DataFrame:
    """Demand, error, flags and stock levels at the fixed lead time and z-score."""
    policy = _policy(_forecast_rows(df), SERIES_KEYS, LEAD_TIME_DAYS, Z_SCORE, 1.0)
    return policy.select(*METRIC_COLUMNS)


def inventory_policy(
    df: DataFrame,
    lead_time_days: int = LEAD_TIME_DAYS,
    z_score: float = Z_SCORE,
    available_stock_multiplier: float = 1.0,
    require_rows: bool = True,
) -> DataFrame:
    """The policy of every group, in no order.

    `require_rows` looks for one usable row and fails without; switch it off for a lazily
    derived input, which that look would compute a second time.
    """
    rows = _forecast_rows(df)
    if require_rows and rows.isEmpty():
        raise ValueError("no complete forecast rows for the inventory policy")
    policy = _policy(rows, SERIES_KEYS, lead_time_days, z_score, available_stock_multiplier)
    return policy.select(*POLICY_COLUMNS)


def inventory_policy_table(
    df: DataFrame,
    lead_time_days: int = LEAD_TIME_DAYS,
    z_score: float = Z_SCORE,
    available_stock_multiplier: float = 1.0,
    require_rows: bool = True,
) -> DataFrame:
    """The policy as a report, riskiest groups first."""
    policy = inventory_policy(df, lead_time_days, z_score, available_stock_multiplier, require_rows)
    return policy.orderBy(
        F.desc("stockout_risk_rate"),
        F.desc("overstock_risk_rate"),
        F.desc("forecast_error"),
        *SERIES_KEYS,
    )


def risk_table_by_source(
    df: DataFrame,
    sources: dict[str, str],
    lead_time_days: int = LEAD_TIME_DAYS,
    z_score: float = Z_SCORE,
    available_stock_multiplier: float = 1.0,
) -> DataFrame:
    """Policy rows per forecast source; `sources` names the column of each source."""
    pairs = [
        F.struct(F.lit(name).alias("source"), number(df, column).alias(FORECAST))
        for name, column in sources.items()
    ]
    tall = df.select(DATE, *SERIES_KEYS, TARGET, F.inline(F.array(*pairs)))
    policy = _policy(
        _forecast_rows(tall, "source"),
        ["source", *SERIES_KEYS],
        lead_time_days,
        z_score,
        available_stock_multiplier,
    )
    return policy.select(*POLICY_COLUMNS, "source")


def _worst_first(policy: DataFrame, rate: str, n: int) -> DataFrame:
    # Rounding keeps summation noise from reordering groups with equal error.
    error = F.round("forecast_error", 9)
    ranking = (F.desc(rate), error.desc(), F.desc("avg_daily_demand"), *SERIES_KEYS)
    return policy.orderBy(*ranking).limit(n)


def top_stockout_products(policy: DataFrame, n: int = 20) -> DataFrame:
    return _worst_first(policy, "stockout_risk_rate", n)


def top_overstock_products(policy: DataFrame, n: int = 20) -> DataFrame:
    return _worst_first(policy, "overstock_risk_rate", n)


def scenario_grid(policy: DataFrame, lead_times: list[int], service_levels: list[float]) -> DataFrame:
    """Stock levels of every group under each lead time and service level.

    Demand is aggregated once; the scenarios are a literal array next to each group.
    """
    scenarios = [
        F.struct(F.lit(days).alias("lead_time_days"), F.lit(level).alias("service_level"))
        for days in lead_times
        for level in service_levels
    ]
    grid = policy.select(*SERIES_KEYS, "avg_daily_demand", "demand_std", F.inline(F.array(*scenarios)))
    lead = F.col("lead_time_days")
    return (
        grid.withColumn("z_score", service_level_z(F.col("service_level")))
        .withColumn(
            "suggested_safety_stock", safety_stock(F.col("demand_std"), lead, F.col("z_score"))
        )
        .withColumn(
            "suggested_reorder_point",
            reorder_point(F.col("avg_daily_demand"), lead, F.col("suggested_safety_stock")),
        )
    )


def risk_summary(policy: DataFrame) -> DataFrame:
    return policy.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if("stockout_risk_flag").alias("stockout_groups"),
        F.count_if("overstock_risk_flag").alias("overstock_groups"),
    )
