"""The dashboard table: forecasts with segments, stock scenarios and group metrics."""

from __future__ import annotations

from functools import reduce

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import number
from shelfline.functions.metrics import forecast_bias, mae, rmse, wmape
from shelfline.operators.validation import between_days
from shelfline.schema import (
    DASHBOARD_COLUMNS,
    DATE,
    SERIES_KEYS,
    normalize_dashboard_columns,
    require_columns,
)

# Column names of the three inputs.
FORECAST_COLUMNS = [DATE, *SERIES_KEYS, "actual_sales", "forecast_sales"]
SEGMENT_COLUMNS = [*SERIES_KEYS, "abc_segment", "xyz_segment", "abc_xyz_segment"]
STOCK_COLUMNS = [
    *SERIES_KEYS,
    "stockout_risk_flag",
    "overstock_risk_flag",
    "suggested_reorder_point",
    "suggested_safety_stock",
]
COMPUTED = ["wmape", "mae", "rmse", "bias"]


def error_metrics(actual: Column, forecast: Column) -> list[Column]:
    """The four error metrics of the dashboard, on unclipped quantities."""
    return [
        wmape(actual, forecast).alias("wmape"),
        mae(actual, forecast).alias("mae"),
        rmse(actual, forecast).alias("rmse"),
        forecast_bias(actual, forecast).alias("bias"),
    ]


def _sales(df: DataFrame, name: str) -> Column:
    return F.coalesce(number(df, name), F.lit(0.0))


def group_metrics(forecast: DataFrame) -> DataFrame:
    """Error metrics per product and market; missing quantities count as zero."""
    require_columns(forecast, [*SERIES_KEYS, "actual_sales", "forecast_sales"], "forecast")
    actual, predicted = _sales(forecast, "actual_sales"), _sales(forecast, "forecast_sales")
    known = forecast.select(*SERIES_KEYS, actual.alias("a"), predicted.alias("f")).dropna(
        subset=SERIES_KEYS
    )
    return known.groupBy(*SERIES_KEYS).agg(*error_metrics(F.col("a"), F.col("f")))


def choose_inventory_source(inventory: DataFrame) -> DataFrame:
    """One row per product and market, from the model scenario when there is one."""
    if "source" in inventory.columns:
        from_model = F.coalesce(F.lower(F.col("source").cast("string")) == "model", F.lit(False))
        any_model = inventory.agg(F.bool_or(from_model).alias("any_model")).scalar()
        inventory = inventory.where(from_model | ~any_model)
    rest = sorted(set(inventory.columns) - set(SERIES_KEYS))
    # The row with the fewest missing values wins, then the smallest; copies of one key are merged
    # map-side, by sorting.
    gaps = reduce(lambda a, b: a + b, (F.col(name).isNull().cast("int") for name in rest), F.lit(0))
    first = inventory.groupBy(*SERIES_KEYS).agg(F.min(F.struct(gaps, F.struct(*rest)))["col2"].alias("first"))
    return first.select(*SERIES_KEYS, "first.*").select(*inventory.columns)


def row_errors(forecast: DataFrame) -> DataFrame:
    """Signed (positive = forecast too low) and absolute error per row."""
    filled = forecast.withColumns(
        {name: _sales(forecast, name) for name in ("actual_sales", "forecast_sales")}
    )
    error = F.col("actual_sales") - F.col("forecast_sales")
    return filled.withColumns({"forecast_error": error, "abs_forecast_error": F.abs(error)})


def dashboard_dataset(
    forecast: DataFrame, segments: DataFrame, inventory: DataFrame, require_rows: bool = True
) -> DataFrame:
    """Twenty fixed columns, one row per forecast row.

    The three group-grain sides are joined with each other first, where they are already
    partitioned by their keys, so the forecast rows take part in one join only.  `revenue` is
    the segment total repeated on every row; never sum it over rows.  `require_rows` fails on an
    empty forecast; switch it off for a lazily derived one, which that look would compute twice.
    """
    forecast = require_columns(normalize_dashboard_columns(forecast), FORECAST_COLUMNS, "forecast")
    segments = require_columns(normalize_dashboard_columns(segments), SEGMENT_COLUMNS, "segments")
    inventory = require_columns(normalize_dashboard_columns(inventory), STOCK_COLUMNS, "inventory")
    if require_rows and forecast.isEmpty():
        raise ValueError("the forecast has no rows")

    rows = row_errors(forecast.withColumn(DATE, F.col(DATE).try_cast("date")))
    shown = {*DASHBOARD_COLUMNS, "source"}
    stock = choose_inventory_source(inventory.select(*(c for c in inventory.columns if c in shown)))
    sides = (
        group_metrics(forecast).alias("metrics")
        .join(segments.alias("segments"), SERIES_KEYS, "left")
        .join(stock.alias("stock"), SERIES_KEYS, "left")
    )

    def first_source(name: str) -> Column | None:
        """The column of the first side that has it; a missing bias may come from a later one."""
        found = [F.col(f"{side}.{name}") for side, columns in held.items() if name in columns]
        if name == "bias":
            return F.coalesce(*found).alias(name)
        return found[0].alias(name) if found else None

    held = {"metrics": COMPUTED, "segments": segments.columns, "stock": stock.columns}
    own = set(rows.columns) - set(COMPUTED)
    picked = [first_source(name) for name in DASHBOARD_COLUMNS if name not in own]
    side = sides.select(
        *(F.col(f"metrics.{key}").alias(key) for key in SERIES_KEYS),
        *(column for column in picked if column is not None),
    )
    board = rows.drop(*COMPUTED).join(side, SERIES_KEYS, "left")
    absent = {"description": F.lit("")}
    return board.withColumns(
        {
            name: absent.get(name, F.lit(None).cast("double"))
            for name in DASHBOARD_COLUMNS
            if name not in board.columns
        }
    ).select(*DASHBOARD_COLUMNS)


def dashboard_order(dashboard: DataFrame) -> DataFrame:
    """Row order of the published table; sorts all rows, so use it at the sink only."""
    return dashboard.orderBy(DATE, *SERIES_KEYS)


def filter_dashboard(
    dashboard: DataFrame,
    period: tuple[date, date] | None = None,
    markets: list[str] | None = None,
    products: list[str] | None = None,
    abc: list[str] | None = None,
    xyz: list[str] | None = None,
    abs_error: tuple[float, float] | None = None,
) -> DataFrame:
    """Rows inside every given filter; plain predicates, so they push down to the scan."""
    if period:
        dashboard = dashboard.where(between_days(dashboard, *period))
    chosen = {"market_id": markets, "stock_code": products, "abc_segment": abc, "xyz_segment": xyz}
    for name, values in chosen.items():
        if values:
            dashboard = dashboard.where(F.col(name).isin(values))
    if abs_error:
        dashboard = dashboard.where(F.col("abs_forecast_error").between(*abs_error))
    return dashboard
