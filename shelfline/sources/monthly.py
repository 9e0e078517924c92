"""Stage tables partitioned by month: readers of a range prune folders, changes replace whole months.

The month is a column of its own beside the date.  Predicates on it stand next to those on the date,
also where the bound is a scalar subquery, so a cutoff found at run time still prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators.mart import daily_sales_mart, with_mart_keys
from shelfline.schema import DATE, MONTH
from shelfline.session import scratch_path


def with_month(df: DataFrame, date_column: str = DATE) -> DataFrame:
    return df.withColumn(MONTH, F.trunc(F.col(date_column), "month"))


def write_months(
    df: DataFrame, path: str, date_column: str = DATE, mode: str = "overwrite"
) -> DataFrame:
    """Write by month: `overwrite` all, `append`, or `replace` only the months that `df` has rows of.

    Rows are gathered by month first, a large month in several tasks; a row without a date has a
    folder of its own.
    """
    if mode not in ("overwrite", "append", "replace"):
        raise ValueError(f"unknown mode: {mode}")
    dated = with_month(df, date_column)
    writer = dated.hint("rebalance", MONTH).write.partitionBy(MONTH)
    if mode == "replace":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.mode("append" if mode == "append" else "overwrite").parquet(path)
    return df.sparkSession.read.schema(dated.schema).parquet(path)


def hand_over_months(df: DataFrame, stem: str, date_column: str = DATE) -> DataFrame:
    """`hand_over` by month, for readers that take ranges of dates."""
    return write_months(df, scratch_path(df.sparkSession, stem), date_column)


def changed_months(changes: DataFrame, date_column: str = DATE) -> list:
    """The months of changed rows, at most one per month of the calendar."""
    months = with_month(changes.select(date_column), date_column).select(MONTH).distinct()
    return [r[0] for r in months.where(F.col(MONTH).isNotNull()).collect()]


def refresh_mart(
    spark: SparkSession, facts_path: str, mart_path: str, changes: DataFrame
) -> DataFrame:
    """Add `changes` to the facts stored by month and recompute the mart of their months alone.

    New and late rows may fall into any month, into one that the mart has not seen as well.  Facts
    and mart of all other months are neither read nor written; a second run with the same changes
    would add them twice, as any append.
    """
    months = changed_months(with_mart_keys(changes))
    facts = write_months(changes, facts_path, mode="append")
    touched = facts.where(F.col(MONTH).isin(months)) if months else facts.limit(0)
    return write_months(daily_sales_mart(touched), mart_path, mode="replace")


