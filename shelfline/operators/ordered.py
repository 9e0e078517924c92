"""Totals and frames over a global order, without one task ever holding the whole order.

Rows are range-partitioned on a full sort key, so even equal values spread over blocks; each
block gets its start offset from the sums of the blocks before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.session import cut_lineage

RUN_ROWS = 100_000  # consecutive rows of a group that one task takes
SHARES = 1024  # blocks that one date of a group is numbered in


def _range_blocks(df: DataFrame, order: list[Column], blocks: int | None) -> DataFrame:
    count = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *order)
    # Block ids depend on sampled boundaries: fix them once for the two reads that follow.
    return cut_lineage(ranged.withColumn("_block", F.spark_partition_id()))


def running_total(
    df: DataFrame,
    value: Column,
    order: list[Column],
    name: str,
    blocks: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add `name`: the sum of `value` over this row and all before it in `order`; and, when
    asked for, `total`: its sum over all rows.

    `order` must be a full sort key.  Block sums number at most one per shuffle partition.
    """
    blocked = _range_blocks(df.withColumn("_value", value), order, blocks)
    sums = blocked.groupBy("_block").agg(F.sum("_value").alias("_sum"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_block", F.sum("_sum").over(earlier).alias("_start"))
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        blocked.withColumn("_inside", F.sum("_value").over(inside))
        .join(F.broadcast(starts), "_block")
        .withColumn(name, F.coalesce(F.col("_start") + F.col("_inside"), F.col("_inside")))
        .drop("_block", "_value", "_start", "_inside")
    )
    if total is None:
        return ranked
    return ranked.withColumn(total, sums.agg(F.sum("_sum").alias("all")).scalar())


def with_frames(
    df: DataFrame,
    groups: list[str],
    order: str,
    reach: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Add window columns that look at most `reach` rows back within a group of any size.

    Every row gets its position in its group: rows are numbered inside blocks (group, date, share
    of the hash of the other columns), and only block counts are summed over a group.  Groups are
    then cut into runs of `run_rows` consecutive rows; each run also receives the last `reach`
    rows of the run before it, so the frames are exact while no task holds more than one run or
    block.  Rows that share a date follow each other by that hash share and then by their other
    columns: a fixed order, the same for every cut.
    """
    ties = [
        f.name
        for f in df.schema.fields
        if f.name not in (*groups, order)
        and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    block = [*groups, order, "_share"]
    placed = df.withColumn("_share", F.pmod(F.xxhash64(*ties), F.lit(SHARES)) if ties else F.lit(0))
    counted = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*groups).orderBy(order, "_share").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counted.select(
        *(F.col(name).alias(f"_in_{name}") for name in block),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*block).orderBy(*(ties or [F.lit(0)]))
    same = reduce(
        lambda a, b: a & b, (F.col(name).eqNullSafe(F.col(f"_in_{name}")) for name in block)
    )
    size = max(run_rows, 2 * reach)
    numbered = (
        placed.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(starts, same)
        .withColumn("_position", F.col("_start") + F.col("_inside"))
        .withColumn("_run", F.floor(F.col("_position") / size))
    )
    feeds_next = F.col("_position") % size >= size - reach
    homes = F.when(feeds_next, F.array("_run", F.col("_run") + 1)).otherwise(F.array("_run"))
    spread = numbered.withColumn("_home", F.explode(homes))
    frames = columns(Window.partitionBy("_home", *groups).orderBy("_position"))
    found = spread.withColumns(frames).where(F.col("_home") == F.col("_run"))
    return found.select(*df.columns, *frames)
