"""Reading the given tables and checking an operator's input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import hand_over

# Narrow sides of up to this many counted rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000

# Whole texts are long, so fewer rows than Spark's default go to Python at a time.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session; a smaller bound that is set stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that others may be called anything."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select(*(df[f"`{name}`"] for name in names))


def small(df: DataFrame, rows: int) -> DataFrame:
    """The side of a join, to be broadcast if its `rows` are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def stored_small(df: DataFrame, stem: str) -> DataFrame:
    """The same for a side that is stored and counted first."""
    stored = hand_over(df, stem)
    return small(stored, stored.count())
