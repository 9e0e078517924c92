"""Places of the elements of a linked list, found by contraction.

First each block of neighbouring numbers shrinks its own stretches of the list to their heads.
While more heads are left than one task may take, random mating halves them: a head whose coin
shows 1 absorbs its successor if that one's shows 0.  What is left is ranked in one task, and
absorbed elements take their places from those that absorbed them, in reverse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.tables import small
from shelfline.session import hand_over

BLOCK_ROWS = 1 << 16  # numbers that one task contracts
LAST_ROWS = 1 << 14  # heads that one task ranks


def ahead_in_chain(before: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first element of its chain, weight ahead of it) for every element, by pointer jumping.

    `before` has each element's predecessor, -1 for none; `steps` the weight of that predecessor.
    """
    head = np.where(before < 0, np.arange(len(before)), before)
    ahead = np.where(before < 0, 0, steps)
    while True:
        further = head[head]
        if np.array_equal(further, head):
            return head, ahead
        ahead, head = ahead + ahead[head], further


def _predecessors(names: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Row of each row's predecessor, -1 if it is not among `names` (sorted)."""
    at = np.searchsorted(names, following)
    there = at < len(names)
    there[there] = names[at[there]] == following[there]
    before = np.full(len(names), -1, np.int64)
    before[at[there]] = np.flatnonzero(there)
    return before


def _contract_block(block: pa.Table) -> pa.Table:
    order = np.argsort(block["arc"].to_numpy(), kind="stable")
    arc, following = (block[n].to_numpy()[order] for n in ("arc", "next"))
    before = _predecessors(arc, following)
    head, ahead = ahead_in_chain(before, np.ones(len(arc), np.int64))
    last = np.ones(len(arc), bool)
    last[before[before >= 0]] = False
    return pa.table(
        {"arc": arc, "head": arc[head], "ahead": ahead, "next": following, "last": last}
    )


def _rank_rest(rest: pa.Table) -> pa.Table:
    order = np.argsort(rest["arc"].to_numpy(), kind="stable")
    arc, following, weight = (rest[n].to_numpy()[order] for n in ("arc", "next", "weight"))
    before = _predecessors(arc, following)
    steps = np.where(before < 0, 0, weight[before])
    return pa.table({"arc": arc, "place": ahead_in_chain(before, steps)[1]})


def _mate(links: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(links left, absorbed (arc, keeper, ahead)) of one round."""
    coin = F.pmod(F.xxhash64("arc", F.lit(number)), F.lit(2))
    tossed = links.withColumn("coin", coin)
    keeper = tossed.where("coin = 1").select(
        F.col("arc").alias("keeper"), F.col("next").alias("arc"), F.col("weight").alias("ahead")
    )
    absorbed = hand_over(
        tossed.where("coin = 0").drop("coin").join(keeper, "arc"), f"absorbed-{number}"
    )
    gained = absorbed.select(
        F.col("keeper").alias("arc"), F.col("next").alias("_next"), F.col("weight").alias("_more")
    )
    left = (
        links.join(absorbed.select("arc"), "arc", "left_anti")
        .join(gained, "arc", "left")
        .select(
            "arc",
            F.coalesce("_next", "next").alias("next"),
            (F.col("weight") + F.coalesce("_more", F.lit(0))).alias("weight"),
        )
    )
    return hand_over(left, f"links-{number}"), absorbed.select("arc", "keeper", "ahead")


def rank_list(
    arcs: DataFrame, block_rows: int = BLOCK_ROWS, last_rows: int = LAST_ROWS
) -> DataFrame:
    """(arc, place) of every element of (arc, next): numbers from 0 without gaps, each the next of
    one other at most, the last one's next -1.  Places run from 0.  Any order of the list is
    right; one whose neighbours have close numbers is contracted at once."""
    block = F.floor(F.col("arc") / block_rows) if block_rows > 1 else F.col("arc")
    chains = hand_over(
        arcs.select("arc", "next", block.cast("bigint").alias("block"))
        .groupBy("block")
        .applyInArrow(
            _contract_block, "arc bigint, head bigint, ahead bigint, next bigint, last boolean"
        ),
        "chains",
    )
    links = hand_over(
        chains.where("last").select(
            F.col("head").alias("arc"), "next", (F.col("ahead") + 1).alias("weight")
        ),
        "links",
    )
    rounds, rows = [], links.count()
    heads = rows
    while rows > last_rows:
        links, absorbed = _mate(links, len(rounds))
        rounds.append(absorbed)
        rows = links.count()
    ranks = links.groupBy(F.lit(0).alias("all")).applyInArrow(_rank_rest, "arc bigint, place bigint")
    for absorbed in reversed(rounds):
        known = ranks.withColumnRenamed("arc", "keeper")
        placed = absorbed.join(known, "keeper").select(
            "arc", (F.col("place") + F.col("ahead")).alias("place")
        )
        ranks = hand_over(ranks.unionByName(placed), "ranks")
    known = small(ranks.select(F.col("arc").alias("head"), F.col("place").alias("_first")), heads)
    return chains.join(known, "head").select(
        "arc", (F.col("_first") + F.col("ahead")).alias("place")
    )
