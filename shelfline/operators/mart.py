"""Invoice rows to the daily sales mart and its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import moment, number, sunday_calendar
from shelfline.schema import (
    FACT_SCHEMA,
    MART_KEYS,
    MART_SCHEMA,
    TRANSACTION_COLUMNS,
    require_columns,
)


def prepare_transactions(df: DataFrame) -> DataFrame:
    """Typed fact rows with return and price flags.  Keeps every row: returns are marked."""
    require_columns(df, TRANSACTION_COLUMNS, "transactions")
    typed = df.select(
        df["invoice"].cast("string").alias("invoice"),
        df["stock_code"].cast("string").alias("stock_code"),
        F.trim(df["description"].cast("string")).alias("description"),
        number(df, "quantity").alias("quantity"),
        moment(df, "invoice_date").alias("invoice_date"),
        number(df, "unit_price").alias("unit_price"),
        df["customer_id"].cast("string").alias("customer_id"),
        df["country"].cast("string").alias("country"),
    )
    quantity, price = F.col("quantity"), F.col("unit_price")
    is_return = F.col("invoice").startswith("C") | (quantity < 0)
    return typed.select(
        "*",
        F.to_date("invoice_date").alias("sales_date"),
        F.trim("country").alias("market_id"),
        F.coalesce(is_return, F.lit(False)).alias("is_return_flag"),
        price.isNull().alias("is_price_missing"),
        F.coalesce(price <= 0, F.lit(True)).alias("is_price_invalid"),
        (quantity * price).alias("revenue"),
    ).select(*FACT_SCHEMA.fieldNames())


def with_mart_keys(fact: DataFrame) -> DataFrame:
    """Fact rows that can enter the mart: no key is NULL (blank strings are kept)."""
    present = F.col(MART_KEYS[0]).isNotNull()
    for key in MART_KEYS[1:]:
        present &= F.col(key).isNotNull()
    return fact.where(present)


def _added() -> dict[str, Column]:
    """What a fact row adds to its mart row."""
    returned, quantity, price = F.col("is_return_flag"), F.col("quantity"), F.col("unit_price")
    valid = ~F.col("is_price_invalid")
    return {
        "sales_qty": F.when(returned, 0.0).otherwise(quantity),
        "returns_qty": F.when(returned, quantity).otherwise(0.0),
        "net_sales_qty": quantity,
        "revenue": F.col("revenue"),
        "price_sum": F.when(valid, price),
        "price_rows": F.when(valid & price.isNotNull(), 1).otherwise(0),
        "is_return_flag": returned,
        "is_price_missing": F.col("is_price_missing"),
    }


def _daily_totals(keyed: DataFrame) -> DataFrame:
    rows = keyed.select(*MART_KEYS, *(c.alias(n) for n, c in _added().items()))
    flags = ("is_return_flag", "is_price_missing")
    totals = ((F.bool_or if n in flags else F.sum)(n).alias(n) for n in _added())
    return rows.groupBy(*MART_KEYS).agg(*totals)


def _finished(daily: DataFrame) -> DataFrame:
    dated = daily.withColumns(
        {
            "returns_qty": F.abs("returns_qty"),
            "avg_unit_price": F.try_divide(F.col("price_sum"), F.col("price_rows")),
            **sunday_calendar(F.col("sales_date")),
        }
    )
    return dated.select(*(c for c in MART_SCHEMA.fieldNames() if c in dated.columns))


def daily_sums(fact: DataFrame) -> DataFrame:
    """The mart without description and distinct counts: one hash aggregation, one exchange."""
    return _finished(_daily_totals(with_mart_keys(fact)))


def _distinct_per_key(keyed: DataFrame, column: str, made: Column) -> DataFrame:
    """One value per mart key from the key's distinct known values of a column.

    Values are grouped with the key first, so a key that holds a third of all rows spreads over its
    values, and counting distinct ones is counting rows.
    """
    known = keyed.where(F.col(column).isNotNull()).select(*MART_KEYS, column)
    return known.distinct().groupBy(*MART_KEYS).agg(made)


def daily_sales_mart(fact: DataFrame) -> DataFrame:
    """One row per sales_date x stock_code x market_id; any description, the smallest, stands.

    Sums, invoices, customers and descriptions are grouped apart, each from its own columns of the
    facts, and joined on the key, which all are partitioned by.  The keys of the parts are unique, so
    a reader that does not select a part's column neither joins nor reads it.  Pass a stored table.
    """
    keyed = with_mart_keys(fact)
    count = F.count(F.lit(1))
    parts = {
        "invoice": count.alias("invoices_cnt"),
        "customer_id": count.alias("customers_cnt"),
        "description": F.min("description").alias("description"),
    }
    daily = _daily_totals(keyed)
    for column, made in parts.items():
        daily = daily.join(_distinct_per_key(keyed, column, made), MART_KEYS, "left")
    counted = {n: F.coalesce(n, F.lit(0).cast("bigint")) for n in ("invoices_cnt", "customers_cnt")}
    return _finished(daily.withColumns(counted))


def dim_date(fact: DataFrame) -> DataFrame:
    days = fact.select("sales_date").where(F.col("sales_date").isNotNull()).distinct()
    return days.withColumns(sunday_calendar(F.col("sales_date")))


def dim_product(fact: DataFrame) -> DataFrame:
    """Most frequent description per product, the smallest one among equals; none only where no
    row has one."""
    uses = (
        fact.where(F.col("stock_code").isNotNull())
        .groupBy("stock_code", "description")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    rank = F.struct(
        F.col("description").isNull(), -F.col("uses"), F.col("description").alias("description")
    )
    return uses.groupBy("stock_code").agg(F.min(rank)["description"].alias("description"))


def dim_market(fact: DataFrame) -> DataFrame:
    markets = fact.select(F.trim("country").alias("market_id"))
    return markets.where(F.col("market_id").isNotNull()).distinct().withColumn("country", F.col("market_id"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once: empty when `keys` is a key of `df`."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.where(F.col("rows") > 1)
