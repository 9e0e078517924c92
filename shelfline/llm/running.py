"""Running totals inside groups of any size: blocks of a sort, and what a group brings along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import cut_lineage


def running_in_groups(
    df: DataFrame,
    group: str,
    order: list[Column],
    totals: dict[str, tuple[Column, Callable[[Column], Column], Callable[[Column, Column], Column]]],
) -> DataFrame:
    """Add each total of `totals`, over this row and those before it in its group.

    A total is (value, aggregate, merge of two aggregates).  Rows are range-partitioned by group
    and `order`, so a group may cover many blocks; a block only learns what its group brings along
    from blocks before it.  Groups in several blocks are at most two per block, so those sums are
    broadcast.  `group` must not be NULL.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, F.col(group), *order)
    # Block numbers depend on sampled bounds: they are fixed once for all readers.
    blocked = cut_lineage(ranged.withColumn("_block", F.spark_partition_id()))
    sums = {f"_sum_{name}": aggregate(value) for name, (value, aggregate, _) in totals.items()}
    parts = blocked.groupBy("_block", group).agg(*(c.alias(n) for n, c in sums.items()))
    spanning = parts.groupBy(group).agg(F.count(F.lit(1)).alias("_blocks")).where("_blocks > 1")
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    brought = parts.join(spanning, group, "left_semi").select(
        "_block",
        group,
        *(
            aggregate(F.col(f"_sum_{name}")).over(earlier).alias(f"_before_{name}")
            for name, (_, aggregate, _) in totals.items()
        ),
    )
    inside = (
        Window.partitionBy("_block", group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = blocked.withColumns(
        {f"_in_{name}": aggregate(value).over(inside) for name, (value, aggregate, _) in totals.items()}
    ).join(F.broadcast(brought), ["_block", group], "left")
    merged = {
        name: F.coalesce(merge(F.col(f"_before_{name}"), F.col(f"_in_{name}")), F.col(f"_in_{name}"))
        for name, (_, _, merge) in totals.items()
    }
    return found.select(*df.columns, *(c.alias(n) for n, c in merged.items()))


def add(a: Column, b: Column) -> Column:
    return a + b


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)
