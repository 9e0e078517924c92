"""Aggregates behind the dashboard pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.metrics import wmape
from shelfline.operators.dashboard import error_metrics
from shelfline.schema import DATE, FORECAST, SERIES_KEYS, TARGET

SEGMENT = "abc_xyz_segment"


def sales_overview(fact: DataFrame) -> DataFrame:
    """Revenue, quantity, invoices and active products per day, from invoice rows."""
    return (
        fact.where(F.col(DATE).isNotNull())
        .groupBy(DATE)
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("quantity").alias("quantity"),
            F.count_distinct("invoice").alias("invoices_cnt"),
            F.count_distinct("stock_code").alias("active_products"),
        )
    )


def _errors_by(rows: DataFrame, *keys: str) -> DataFrame:
    actual, forecast = F.col(TARGET), F.col(FORECAST)
    return rows.groupBy(*keys).agg(
        *error_metrics(actual, forecast),
        F.coalesce(F.sum(F.abs(actual - forecast)), F.lit(0.0)).alias("abs_error"),
    )


def with_segments(rows: DataFrame, segments: DataFrame) -> DataFrame:
    return rows.join(segments.select(*SERIES_KEYS, SEGMENT), SERIES_KEYS, "left")


def error_by_market(rows: DataFrame) -> DataFrame:
    """Error metrics and share of the total absolute error per market."""
    markets = _errors_by(rows, "market_id")
    total = markets.agg(F.sum("abs_error").alias("total")).scalar()
    portion = F.coalesce(F.try_divide(F.col("abs_error"), total), F.lit(0.0))
    return markets.withColumn("abs_error_share", portion)


def error_by_segment(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Error metrics per segment, worst first."""
    return _errors_by(with_segments(rows, segments), SEGMENT).orderBy(F.desc("wmape"), SEGMENT)


def error_by_product(rows: DataFrame, n: int = 20) -> DataFrame:
    """The products with the largest absolute error."""
    return _errors_by(rows, "stock_code").orderBy(F.desc("abs_error"), "stock_code").limit(n)


def daily_actual_vs_forecast(rows: DataFrame) -> DataFrame:
    return rows.groupBy(DATE).agg(
        F.sum(TARGET).alias("actual_sales"), F.sum(FORECAST).alias("forecast_sales")
    )


def abc_xyz_matrix(segments: DataFrame) -> DataFrame:
    """Groups and share of revenue per ABC row and XYZ column."""
    cells = (
        segments.groupBy("abc_segment")
        .pivot("xyz_segment", ["X", "Y", "Z"])
        .agg(F.count(F.lit(1)).alias("groups"), F.sum("revenue").alias("revenue"))
    )
    parts = [F.coalesce(F.sum(f"{x}_revenue"), F.lit(0.0)) for x in "XYZ"]
    total = cells.agg((parts[0] + parts[1] + parts[2]).alias("total")).scalar()
    return cells.select(
        "abc_segment",
        *(F.coalesce(f"{x}_groups", F.lit(0)).alias(f"{x}_groups") for x in "XYZ"),
        *(
            F.coalesce(F.try_divide(F.col(f"{x}_revenue"), total), F.lit(0.0)).alias(
                f"{x}_revenue_share"
            )
            for x in "XYZ"
        ),
    )


def risk_matrix(policy: DataFrame, segments: DataFrame) -> DataFrame:
    """Share of flagged groups per market and segment."""
    return (
        with_segments(policy, segments)
        .groupBy("market_id", SEGMENT)
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.avg(F.col("stockout_risk_flag").cast("double")).alias("stockout_share"),
            F.avg(F.col("overstock_risk_flag").cast("double")).alias("overstock_share"),
        )
    )


def forecasts_by_segment(rows: DataFrame, segments: DataFrame, sources: dict[str, str]) -> DataFrame:
    """WMAPE of each forecast source per segment, and the source that does best there."""
    wide = (
        with_segments(rows, segments)
        .groupBy(SEGMENT)
        .agg(*(wmape(F.col(TARGET), F.col(c)).alias(f"_{name}") for name, c in sources.items()))
    )
    scores = F.array(
        *(F.struct(F.col(f"_{n}").alias("wmape"), F.lit(n).alias("source")) for n in sources)
    )
    return (
        wide.withColumn("scores", scores)
        .withColumn("best_source", F.array_min("scores")["source"])
        .select(SEGMENT, F.inline("scores"), "best_source")
        .select(SEGMENT, "source", "wmape", "best_source")
    )


def revenue_vs_error(stats: DataFrame, metrics: DataFrame) -> DataFrame:
    """Revenue next to the error metrics of each product and market."""
    return metrics.join(stats.select(*SERIES_KEYS, "revenue"), SERIES_KEYS)


def top_revenue_products(mart: DataFrame, n: int = 20) -> DataFrame:
    products = mart.groupBy("stock_code").agg(
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue")
    )
    total = products.agg(F.sum("revenue").alias("total")).scalar()
    return (
        products.orderBy(F.desc("revenue"), "stock_code")
        .limit(n)
        .withColumn("revenue_share", F.coalesce(F.try_divide(F.col("revenue"), total), F.lit(0.0)))
    )
