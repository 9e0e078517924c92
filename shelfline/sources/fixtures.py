"""The retail inputs expressed over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _invoice_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    buyers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation")
    parts = table(spark, folder, "part")
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(buyers, orders["o_custkey"] == buyers["c_custkey"])
        .join(nations, buyers["c_nationkey"] == nations["n_nationkey"])
        .join(parts, lines["l_partkey"] == parts["p_partkey"])
    )


def _typed(lines: DataFrame, *extra: str) -> DataFrame:
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    returned, quantity = F.col("l_returnflag") == "R", F.col("l_quantity")
    code = F.when(part % 211 == 0, None).when(part % 223 == 0, "").otherwise(F.col("p_brand"))
    cents = F.floor(F.col("l_extendedprice") / quantity * 100) / F.lit(100.0)
    customer = F.col("o_custkey")
    return lines.select(
        F.concat(F.when(returned, "C").otherwise(""), order.cast("string")).alias("invoice"),
        code.alias("stock_code"),
        F.when(part % 3 != 0, F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("description"),
        F.when(returned, -quantity).otherwise(quantity).alias("quantity"),
        F.when(order % 1009 != 0, F.col("l_shipdate").cast("timestamp")).alias("invoice_date"),
        F.when(part % 97 == 0, None).when(part % 89 == 0, 0.0).otherwise(cents).alias("unit_price"),
        F.when(customer % 50 != 0, customer.cast("string")).alias("customer_id"),
        F.concat(F.lit(" "), "n_name").alias("country"),
        *extra,
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Typed invoice rows with missing and invalid values mixed in."""
    return _typed(_invoice_lines(spark, folder))


# The headers of a raw invoice export.
RAW_HEADERS = [
    "Invoice",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "Price",
    "Customer ID",
    "Country",
]


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """All-text invoice rows under raw headers, with junk values and repeated rows."""
    rows = _typed(_invoice_lines(spark, folder), "l_orderkey", "l_partkey")
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    junk = rows.withColumns(
        {
            "invoice_date": F.when(order % 1013 == 0, "not a date")
            .when(order % 101 == 0, "8:26")
            .when(order % 103 == 0, F.date_format("invoice_date", "M/d/yyyy H:mm:ss"))
            .when(order % 107 == 0, F.date_format("invoice_date", "M/d/yy H:mm"))
            .when(order % 109 == 0, F.date_format("invoice_date", "M-d-yyyy H:mm"))
            .when(order % 113 == 0, F.date_format("invoice_date", "d MMM yyyy"))
            .when(order % 127 == 0, F.date_format("invoice_date", "yyyyMMdd"))
            .otherwise(F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss")),
            "unit_price": F.when(part % 101 == 0, "abc")
            .when(part % 103 == 0, "0x1p3")
            .when(part % 107 == 0, "12d")
            .otherwise(F.col("unit_price").cast("string")),
            "quantity": F.col("quantity").cast("string"),
        }
    )
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("l_orderkey") % 997 == 0, 2).otherwise(1)))
    return junk.withColumn("copy", copies).drop("copy", "l_orderkey", "l_partkey").toDF(*RAW_HEADERS)


def dense_sales(spark: SparkSession, folder: str) -> DataFrame:
    """A mart-grain series without gaps, from the event stream."""
    events = table(spark, folder, "events")
    value = F.col("value")
    return (
        events.groupBy(
            F.to_date("ts").alias("sales_date"),
            F.col("event_type").alias("stock_code"),
            F.concat(F.lit("M"), (F.col("user_id") % 5).cast("string")).alias("market_id"),
        )
        .agg(
            F.round(F.sum(F.when(F.col("event_id") % 4 == 0, -2 * value).otherwise(value)), 2).alias(
                "net_sales_qty"
            ),
            F.avg("value").alias("avg_unit_price"),
            F.count(F.lit(1)).alias("invoices_cnt"),
            F.count_distinct("user_id").alias("customers_cnt"),
            F.sum("value").alias("revenue"),
        )
    )
