"""The chain of stages from invoice rows to the dashboard."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from shelfline.operators.baselines import add_baselines
from shelfline.operators.dashboard import dashboard_dataset, dashboard_order
from shelfline.operators.features import feature_view
from shelfline.operators.inventory import (
    inventory_metrics,
    inventory_policy,
    inventory_policy_table,
)
from shelfline.operators.mart import daily_sales_mart, prepare_transactions
from shelfline.operators.segments import abc_xyz_segments
from shelfline.operators.validation import train_holdout_split
from shelfline.schema import DATE, FORECAST, SERIES_KEYS, TARGET
from shelfline.session import hand_over
from shelfline.sources.io import forecast_columns, register_views, write_reports


def baseline_forecast(
    mart: DataFrame, baseline: str = "moving_average_28", holdout_days: int = 28
) -> DataFrame:
    """Held-out rows with one baseline as their forecast; rows without history are left out."""
    forecast = add_baselines(mart, [baseline]).withColumnRenamed(baseline, FORECAST)
    # The cutoff comes from the mart itself, so only its dates are read for it.
    _, holdout = train_holdout_split(forecast, DATE, holdout_days)
    return holdout.where(holdout[FORECAST].isNotNull()).select(DATE, *SERIES_KEYS, TARGET, FORECAST)


def sql_stages(transactions: DataFrame, holdout_days: int = 28) -> dict[str, DataFrame]:
    """Register and return every stage of the SQL chain."""
    fact = hand_over(prepare_transactions(transactions), "facts")
    mart = hand_over(daily_sales_mart(fact), "mart")
    forecast = hand_over(baseline_forecast(mart, holdout_days=holdout_days), "forecast")
    stages = {
        "fct_transactions": fact,
        "mart_daily_sales": mart,
        "features_lags_rolling": feature_view(mart),
        "forecast_vs_actual_sample": forecast,
        "inventory_metrics": inventory_metrics(forecast),
    }
    register_views(stages)
    return stages


def dashboard_from_mart(mart: DataFrame, forecast: DataFrame) -> DataFrame:
    """Dashboard of a forecast, with segments and policy derived from the same data.

    Both inputs are read several times: hand over stored tables.
    """
    segments = abc_xyz_segments(mart)
    policy = inventory_policy(forecast, require_rows=False)
    return dashboard_dataset(forecast, segments, policy, require_rows=False)


def publish(
    mart: DataFrame,
    forecast: DataFrame,
    folder: str,
    kind: str = "parquet",
    run: Mapping[str, object] | None = None,
) -> list[str]:
    """Write what a run hands on: segments, the ordered policy and dashboard, the forecast, and of a
    model run its metrics, comparison and importances.  Returns the paths.

    The inputs are read several times: hand over stored tables.
    """
    segments = hand_over(abc_xyz_segments(mart), "segments")
    policy = hand_over(inventory_policy(forecast, require_rows=False), "policy")
    board = dashboard_dataset(forecast, segments, policy, require_rows=False)
    reports = {
        "segments": segments,
        "inventory_policy": inventory_policy_table(forecast, require_rows=False),
        "dashboard": dashboard_order(board),
        "forecast": forecast_columns(forecast),
    }
    parts = {"metrics": "model_metrics", "comparison": "model_comparison",
             "feature_importance": "feature_importance"}
    reports |= {name: run[part] for part, name in parts.items()} if run else {}
    return write_reports(reports, folder, kind)
