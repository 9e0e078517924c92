"""The trie of conversation prefixes, summed over subtrees by the Euler-tour technique.

A node is a distinct sequence of first turns; its fingerprint is 128 bits, the exclusive or of a
hash of each turn's place, role and text, so prefixes are running totals.  Nodes are numbered by
smallest member and depth.  Every node has an enter and an exit arc; the arc behind each is known
from first children, next siblings and parents.  Ranking that list gives arc positions, and a
subtree's leaves and savings are differences of prefix sums between its two arcs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.list_ranking import BLOCK_ROWS, LAST_ROWS, rank_list
from shelfline.llm.running import add, running_in_groups, xor
from shelfline.llm.tables import columns, small
from shelfline.operators.ordered import running_total
from shelfline.session import hand_over

# Fixed values of the rebuilding: heads are shorter than HEADS turns and come from the first
# conversation of each FAMILY.
FAMILY = 5
HEADS = 9
DIGEST_BITS = 10  # conversation numbers that agree above these bits are joined before the digest
PRINT = ["depth", "f1", "f2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Store (conv_id, place, h1, h2, bytes): each turn's place from 1 by `turn`, NULL first.

    Turns that share a number follow each other by hashes of role and text.  A NULL role or text
    is empty; rows without a conversation are no turns.
    """
    said = {n: F.coalesce(n, F.lit("")) for n in ("role", "text")}
    turns = (
        columns(conversations, ["conv_id", "turn", "role", "text"])
        .where(F.col("conv_id").isNotNull())
        .select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            "turn",
            F.xxhash64(said["role"], said["text"]).alias("h1"),
            F.xxhash64(said["text"], F.lit(1), said["role"]).alias("h2"),
            F.octet_length(said["text"]).cast("bigint").alias("bytes"),
        )
    )
    order = [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    one = F.lit(1).cast("bigint")
    placed = running_in_groups(turns, "conv_id", order, {"place": (one, F.sum, add)})
    return hand_over(placed.drop("turn"), "turns")


def plain_sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) of `ordered_turns` as they are, for `prefix_trie`."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    return turns.withColumnRenamed("place", "depth"), lengths


def rebuilt_sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with each conversation's first h turns replaced by those of its family's first
    one: h is crc32 of the decimal number mod 9.

    Rows are (conv_id, depth, h1, h2, bytes), conversations (conv_id, length).
    """
    said = ["h1", "h2", "bytes"]
    c = F.col("conv_id")
    own = turns.groupBy("conv_id").agg(F.max("place").alias("turns")).select(
        "conv_id",
        "turns",
        (c - c % FAMILY).alias("source"),
        (F.crc32(c.cast("string").cast("binary")) % HEADS).alias("head"),
    )
    first = (
        turns.where((c % FAMILY == 0) & (F.col("place") < HEADS))
        .groupBy(c.alias("source"))
        .agg(F.sort_array(F.collect_list(F.struct("place", *said))).alias("firsts"))
    )
    heads = F.slice(F.coalesce("firsts", F.array()), 1, F.col("head").cast("int"))
    family = hand_over(
        own.join(first, "source", "left")
        .withColumn("heads", heads)
        .select(
            "conv_id",
            "head",
            "heads",
            F.size("heads").cast("bigint").alias("taken"),
            (F.size("heads") + F.greatest(F.col("turns") - F.col("head"), F.lit(0))).alias(
                "length"
            ),
        ),
        "families",
    )
    taken = family.select("conv_id", F.explode("heads").alias("at")).select(
        "conv_id", F.col("at.place").alias("depth"), *(f"at.{n}" for n in said)
    )
    shift = small(family.select("conv_id", "head", "taken"), family.count())
    kept = (
        turns.join(shift, "conv_id")
        .where(F.col("place") > F.col("head"))
        .select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), *said)
    )
    return taken.unionByName(kept), family.select("conv_id", "length")


def _digests(ends: DataFrame) -> DataFrame:
    """(fingerprint, ends_sha256) of the conversation numbers that end at each node.

    Numbers are joined in blocks first; a digest then reads its blocks one by one, so no task
    holds a node's whole list.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())]
        )
        current, state = None, None
        for batch in batches:
            done = []
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)))
            for *node, listed in rows:
                if node != current:
                    if current is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = node, sha256()
                else:
                    state.update(b",")
                state.update(listed.encode())
            if done:
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*done), schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        if current is not None:
            arrays = [pa.array([v], f.type) for v, f in zip((*current, state.hexdigest()), schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    block = F.shiftright("conv_id", DIGEST_BITS).alias("block")
    joined = (
        ends.groupBy(*PRINT, block)
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select(*PRINT, "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )
    return (
        joined.repartition(*PRINT)
        .sortWithinPartitions(*PRINT, "block")
        .mapInArrow(digest, "depth bigint, f1 bigint, f2 bigint, ends_sha256 string")
    )


def _sums_between_arcs(arcs: DataFrame, block_rows: int) -> DataFrame:
    """(node, n_leaves, saved_tokens) from (arc, place, leaf, saved): prefix sums at places."""
    named = ("leaf", "saved")
    blocked = hand_over(
        arcs.withColumn("block", F.floor(F.col("place") / block_rows).cast("bigint")), "placed"
    )
    sums = blocked.groupBy("block").agg(*(F.sum(n).alias(n) for n in named))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = hand_over(
        sums.select(
            "block",
            *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in named),
        ),
        "starts",
    )
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # Up to an exit arc with its subtree, less up to the enter arc without its node.
    running = blocked.select(
        "block",
        F.floor(F.col("arc") / 2).cast("bigint").alias("node"),
        (F.col("arc") % 2 == 1).alias("leaves"),
        *((F.sum(n).over(inside) - F.col(n)).alias(n) for n in named),
    ).join(small(starts, starts.count()), "block")

    def spanned(name: str):
        total = F.col(name) + F.col(f"_{name}")
        return F.sum(F.when(F.col("leaves"), total).otherwise(-total))

    return running.groupBy("node").agg(
        spanned("leaf").alias("n_leaves"), spanned("saved").alias("saved_tokens")
    )


def prefix_trie(
    rows: DataFrame,
    conversations: DataFrame,
    block_rows: int = BLOCK_ROWS,
    last_rows: int = LAST_ROWS,
) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 of every node of the trie of (conv_id, depth, h1, h2, bytes) rows.

    `conversations` has each (conv_id, length) once; those without turns end at the root.  No
    conversation gives no node.
    """
    seeds = {"f1": F.lit(11), "f2": F.lit(13)}
    prints = {
        name: (F.xxhash64(seed, "depth", "h1", "h2"), F.bit_xor, xor)
        for name, seed in seeds.items()
    }
    path = running_in_groups(rows, "conv_id", [F.col("depth")], prints)
    path = hand_over(
        path.select(
            "conv_id",
            "depth",
            *prints,
            *(xor(F.col(n), prints[n][0]).alias(f"p{n[1]}") for n in prints),
            "bytes",
        ),
        "paths",
    )
    zero = F.lit(0).cast("bigint")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = (
        path.groupBy(*PRINT)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            *(F.min(n).alias(n) for n in ("p1", "p2", "bytes")),
        )
        .unionByName(
            root.where("n_convs > 0").withColumns(dict.fromkeys([*PRINT, "p1", "p2", "bytes"], zero))
        )
    )
    order = [F.col("conv_id"), F.col("depth")]
    nodes = hand_over(
        running_total(nodes, F.lit(1), order, "node").withColumn(
            "node", (F.col("node") - 1).cast("bigint")
        ),
        "nodes",
    )
    count = nodes.count()
    # The root is the parent of as many nodes as there are first turns: those need no join.
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("f1").alias("p1"),
        F.col("f2").alias("p2"),
        F.col("node").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    under = nodes.select("node", "depth", "p1", "p2").where("depth > 1")
    first_level = nodes.where("depth = 1").select(
        "node", zero.alias("parent"), nodes.where("depth = 0").select("conv_id").scalar().alias("parent_conv_id")
    )
    children = (
        under.join(above.where("depth > 1"), ["depth", "p1", "p2"])
        .select("node", "parent", "parent_conv_id")
        .unionByName(first_level)
    )
    # Siblings in a row of their own: the next one has the next number.
    lined = hand_over(
        running_total(children, F.lit(1), [F.col("parent"), F.col("node")], "line"), "children"
    )
    ahead = lined.select(
        (F.col("line") - 1).alias("line"), "parent", F.col("node").alias("sibling")
    )
    siblings = lined.join(ahead, ["line", "parent"], "left")
    families = lined.groupBy(F.col("parent").alias("node")).agg(
        F.min("node").alias("first"), F.count(F.lit(1)).alias("n_children")
    )
    linked = hand_over(
        nodes.join(siblings.select("node", "parent", "parent_conv_id", "sibling"), "node", "left")
        .join(families, "node", "left")
        .select(
            *nodes.columns,
            "parent_conv_id",
            F.coalesce("n_children", zero).alias("n_children"),
            F.coalesce(2 * F.col("first"), 2 * F.col("node") + 1).alias("behind_enter"),
            F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1, F.lit(-1)).alias(
                "behind_exit"
            ),
        ),
        "linked",
    )
    enter, exit_ = 2 * F.col("node"), 2 * F.col("node") + 1
    arcs = linked.select(enter.alias("arc"), F.col("behind_enter").alias("next")).unionByName(
        linked.select(exit_.alias("arc"), F.col("behind_exit").alias("next"))
    )
    places = rank_list(arcs, block_rows, last_rows)
    values = linked.select(
        enter.alias("arc"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    weighed = places.join(values, "arc", "left").select(
        "arc", "place", *(F.coalesce(n, zero).alias(n) for n in ("leaf", "saved"))
    )
    sums = _sums_between_arcs(weighed, block_rows)
    lengths = small(conversations.select("conv_id", F.col("length").alias("depth")), count)
    ends = (
        path.join(lengths, ["conv_id", "depth"], "left_semi")
        .select(*PRINT, "conv_id")
        .unionByName(
            conversations.where("length = 0").select(
                *(zero.alias(n) for n in PRINT), "conv_id"
            )
        )
    )
    return (
        linked.join(sums, "node")
        .join(_digests(ends), PRINT, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """The nodes of all conversations, rebuilt within their families or as they are.

    A NULL role or text is empty, a NULL turn comes first, equal turns are told apart by place
    alone; rows without a conv_id are left out, other columns are dropped, and an empty table has
    no node, not even a root.
    """
    turns = ordered_turns(conversations)
    return prefix_trie(*(rebuilt_sequences if rebuild else plain_sequences)(turns))
