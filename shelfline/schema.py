"""Column names, types and contracts of the tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SERIES_KEYS = ["stock_code", "market_id"]
DATE = "sales_date"
MONTH = "sales_month"  # first day of the month, in tables stored by month
TARGET = "net_sales_qty"
FORECAST = "forecast_net_sales_qty"
MART_KEYS = [DATE, *SERIES_KEYS]

# Names of the input and output columns, and the accepted header spellings.
TRANSACTION_COLUMNS = [
    "invoice",
    "stock_code",
    "description",
    "quantity",
    "invoice_date",
    "unit_price",
    "customer_id",
    "country",
]

# Fixed values.
TRANSACTION_ALIASES = {
    "invoice": "invoice",
    "invoiceno": "invoice",
    "stockcode": "stock_code",
    "description": "description",
    "quantity": "quantity",
    "invoicedate": "invoice_date",
    "price": "unit_price",
    "unitprice": "unit_price",
    "customerid": "customer_id",
    "country": "country",
}

# Fixed values.
DASHBOARD_ALIASES = {
    "date": "sales_date",
    "actual": "actual_sales",
    "actual_qty": "actual_sales",
    "net_sales_qty": "actual_sales",
    "sales": "actual_sales",
    "forecast": "forecast_sales",
    "forecast_qty": "forecast_sales",
    "forecast_net_sales_qty": "forecast_sales",
    "model_forecast": "forecast_sales",
    "forecast_bias": "bias",
    "stockout_flag": "stockout_risk_flag",
    "overstock_flag": "overstock_risk_flag",
    "reorder_point": "suggested_reorder_point",
    "safety_stock": "suggested_safety_stock",
}

# Fixed values.
DASHBOARD_COLUMNS = [
    "sales_date",
    "stock_code",
    "description",
    "market_id",
    "abc_segment",
    "xyz_segment",
    "abc_xyz_segment",
    "actual_sales",
    "forecast_sales",
    "forecast_error",
    "abs_forecast_error",
    "wmape",
    "mae",
    "rmse",
    "bias",
    "revenue",
    "stockout_risk_flag",
    "overstock_risk_flag",
    "suggested_reorder_point",
    "suggested_safety_stock",
]


# The fact table's columns and types.
FACT_SCHEMA = T.StructType(
    [
        T.StructField("invoice", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("invoice_date", T.TimestampType()),
        T.StructField("sales_date", T.DateType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("market_id", T.StringType()),
        T.StructField("is_return_flag", T.BooleanType()),
        T.StructField("is_price_missing", T.BooleanType()),
        T.StructField("is_price_invalid", T.BooleanType()),
        T.StructField("revenue", T.DoubleType()),
    ]
)

# The mart's columns and types.
MART_SCHEMA = T.StructType(
    [
        T.StructField("sales_date", T.DateType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("market_id", T.StringType()),
        T.StructField("sales_qty", T.DoubleType()),
        T.StructField("avg_unit_price", T.DoubleType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("invoices_cnt", T.LongType()),
        T.StructField("customers_cnt", T.LongType()),
        T.StructField("returns_qty", T.DoubleType()),
        T.StructField("net_sales_qty", T.DoubleType()),
        T.StructField("weekday", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("is_weekend", T.BooleanType()),
        T.StructField("is_return_flag", T.BooleanType()),
        T.StructField("is_price_missing", T.BooleanType()),
    ]
)


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], name: str = "input") -> DataFrame:
    """Fail before any job runs when a required column is absent."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def _rename(df: DataFrame, names: list[str]) -> DataFrame:
    clashes = sorted({name for name in names if names.count(name) > 1})
    if clashes:
        raise ValueError(f"several input columns map to: {', '.join(clashes)}")
    return df.toDF(*names)


def transaction_column_name(name: str) -> str:
    """snake_case name; known header spellings are found with or without underscores."""
    snake = "_".join(name.strip().lower().replace("-", "_").split())
    return TRANSACTION_ALIASES.get(snake.replace("_", ""), snake)


def normalize_column_names(df: DataFrame) -> DataFrame:
    return _rename(df, [transaction_column_name(name) for name in df.columns])


def normalize_dashboard_columns(
    df: DataFrame, aliases: Mapping[str, str] = DASHBOARD_ALIASES
) -> DataFrame:
    cleaned = [n.strip().lower().replace("-", "_").replace(" ", "_") for n in df.columns]
    return _rename(df, [aliases.get(name, name) for name in cleaned])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, cast to its types."""
    require_columns(df, schema.fieldNames())
    return df.select(*(df[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields))
