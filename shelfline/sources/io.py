"""Reading raw files and handing tables between stages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.schema import (
    DATE,
    FORECAST,
    SERIES_KEYS,
    TARGET,
    TRANSACTION_COLUMNS,
    normalize_column_names,
    normalize_dashboard_columns,
    require_columns,
)
from shelfline.sources.records import broken_records

# Texts that stand for a missing value in a delimited file.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


# Quotes are doubled inside quoted fields.
CSV = {"quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted fields may hold line breaks.

    A first pass looks for such breaks.  Files without any are read as lines, others as records that
    many tasks cut from each file.
    """
    rows = spark.read.option("header", True).options(**CSV).option("inferSchema", False).csv(path)
    records = broken_records(spark, path)
    if records is not None:
        names = rows.columns
        schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
        fields = F.from_csv("record", schema, CSV)
        rows = records.select(fields.alias("fields")).select("fields.*").toDF(*names)
    return rows.select(
        *(F.when(~rows[f"`{c}`"].isin(MISSING_TEXTS), rows[f"`{c}`"]).alias(c) for c in rows.columns)
    )


def _read(spark: SparkSession, path: str) -> DataFrame:
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"only .csv and .parquet inputs can be read: {path}")


def read_transactions(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """Stack the inputs under normalised names; fails when a required column is absent."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = [normalize_column_names(_read(spark, path)) for path in paths]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return require_columns(stacked, TRANSACTION_COLUMNS, "transactions")


def read_source(spark: SparkSession, path: str, required: Iterable[str]) -> DataFrame:
    """A forecast, segment or inventory file under the dashboard's column names."""
    return require_columns(
        normalize_dashboard_columns(_read(spark, path)), required, path
    )


def write_table(
    df: DataFrame, path: str, kind: str = "parquet", partition_by: Iterable[str] = ()
) -> str:
    """Write as parquet or CSV; partition the mart by year and month.

    Rows are gathered by partition first, with large partitions split over several tasks, so
    that no task writes a small file into every partition.
    """
    columns = list(partition_by)
    if columns:
        df = df.hint("rebalance", *columns)
    writer = df.write.mode("overwrite").partitionBy(*columns)
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        # Keep blanks around texts, as the reader does.
        (
            writer.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        raise ValueError(f"unknown table kind: {kind}")
    return path


def write_bucketed(df: DataFrame, table: str, buckets: int) -> DataFrame:
    """Save a series table bucketed by its keys and sorted by date.

    Feature and baseline windows, segments and the policy read it without another shuffle.
    """
    ranged = df.repartition(buckets, *SERIES_KEYS)
    (
        ranged.write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, *SERIES_KEYS)
        .sortBy(*SERIES_KEYS, DATE)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def forecast_columns(df: DataFrame, target: str = TARGET) -> DataFrame:
    """The keys and the target, as far as present, and the forecast."""
    require_columns(df, [FORECAST], "predictions")
    return df.select(*(c for c in [DATE, *SERIES_KEYS, target] if c in df.columns), FORECAST)


def write_forecast(df: DataFrame, path: str, kind: str = "parquet", target: str = TARGET) -> str:
    return write_table(forecast_columns(df, target), path, kind)


def write_reports(reports: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    """Write each report below `folder` under its name."""
    return [
        write_table(df, f"{folder.rstrip('/')}/{name}.{kind}", kind) for name, df in reports.items()
    ]


def register_views(stages: Mapping[str, DataFrame]) -> None:
    """Make each stage available to SQL under its name."""
    for name, df in stages.items():
        df.createOrReplaceTempView(name)
