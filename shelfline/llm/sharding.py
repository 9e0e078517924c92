"""Jump consistent hashing of stable keys to shards, in SQL functions only.

A key walks through growing shard numbers: from shard b it jumps to floor((b + 1) * 2^31 / (r + 1)),
where r, 31 bits, comes from the key and the number of the step.  The last shard below the count
is the key's.  No ring table is kept, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.tables import columns

RING = 1 << 31
BLOCKS = 256  # parts of a shard that are numbered apart


def jump_shards(key: Column, counts: list[int]) -> Column:
    """Shard of `key` for each of the shard counts, as an array of ints; a NULL key hashes as
    the empty text."""
    top = max(counts)
    text = F.coalesce(key.cast("string"), F.lit(""))

    def step(walk: Column, number: Column) -> Column:
        digits = F.substring(F.md5(F.concat(text, F.lit(":"), number.cast("string"))), 1, 8)
        draw = F.shiftright(F.conv(digits, 16, 10).cast("bigint"), 1)
        reached = F.floor((walk["next"] + 1) * F.lit(RING) / (draw + 1)).cast("bigint")
        found = [
            F.when(walk["next"] < count, walk["next"]).otherwise(walk[f"s{i}"]).alias(f"s{i}")
            for i, count in enumerate(counts)
        ]
        moved = F.struct(reached.alias("next"), *found)
        return F.when(walk["next"] >= top, walk).otherwise(moved)

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("next"), *(zero.alias(f"s{i}") for i in range(len(counts))))
    # Each step moves on by one shard at least, so `top` steps reach the end.
    steps = F.sequence(F.lit(1), F.lit(top))
    return F.aggregate(
        steps, start, step, lambda walk: F.array(*(walk[f"s{i}"] for i in range(len(counts))))
    )


def shard(
    df: DataFrame, key: str, shards: int, by: list[str], blocks: int = BLOCKS
) -> DataFrame:
    """Add `shard`, `grown_shard` (with one shard more) and `slot`, the row's place in its shard.

    Slots run from 0 without gaps, by block and then by `by`.  A shard is cut into `blocks` blocks
    by a hash of the `by` columns, so no task holds a whole shard; only block counts, shards x
    blocks rows, are summed over a shard.  Rows that agree in
    `by` take their slots in any order.  A NULL key is a key like any other; an empty table
    stays empty; further columns are kept, unless they carry one of the added names.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    clash = {"shard", "grown_shard", "slot", "_block"} & set(df.columns)
    if clash:
        raise ValueError(f"columns would be overwritten: {', '.join(sorted(clash))}")
    found = jump_shards(F.col(f"`{key}`"), [shards, shards + 1])
    # A repeated key may hold many rows, so the block comes from the ordering columns.
    text = F.concat_ws(":", *(F.col(f"`{c}`").cast("string") for c in by))
    block = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % blocks
    placed = df.withColumn("_found", found).withColumns(
        {
            "shard": F.col("_found")[0].cast("int"),
            "grown_shard": F.col("_found")[1].cast("int"),
            "_block": block,
        }
    )
    placed = placed.drop("_found")
    sizes = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("shard").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        "shard", "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("shard", "_block").orderBy(*(F.col(f"`{c}`") for c in by))
    return (
        placed.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "_block"])
        .withColumn("slot", F.col("_start") + F.col("_inside"))
        .select(*(F.col(f"`{c}`") for c in df.columns), "shard", "slot", "grown_shard")
    )


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Documents by the `key` law: the key and the shard count alone decide the shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot and
    grown_shard.  A missing text counts no bytes and has the checksum of the empty text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = columns(documents, ["doc_id", "text"]).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shard(rows, "doc_id", shards, ["doc_id", "size", "text_crc32"])
