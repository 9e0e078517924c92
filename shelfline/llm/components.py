"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.session import hand_over


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents (node, root) to the end; every parent is smaller than its node or itself."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("_above"))
        parents = hand_over(
            parents.join(up, "root", "left").select(
                "node",
                F.coalesce("_above", "root").alias("root"),
                (F.col("_above") < F.col("root")).alias("_moved"),
            ),
            "roots",
        )
        moved = parents.where("_moved").isEmpty()
        parents = parents.drop("_moved")
        if moved:
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) reaches.

    Each round, every node moves to its smallest neighbour and each tree becomes one node, so the
    nodes that still have links at least halve; nothing but the round's end reaches the driver.
    """
    edges = hand_over(links.select("a", "b").where("a != b").distinct(), "links")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(
            F.least("node", F.min("b")).alias("root")
        )
        step = _roots(hand_over(parents, "parents"))
        if found is None:
            found = step
        else:
            on = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            found = hand_over(
                found.join(on, "root", "left").select(
                    "node", F.coalesce("_next", "root").alias("root")
                ),
                "components",
            )
        to = step.select(F.col("node"), F.col("root"))
        edges = hand_over(
            edges.join(to.toDF("a", "_a"), "a")
            .join(to.toDF("b", "_b"), "b")
            .where("_a != _b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
            .distinct(),
            "links",
        )
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return found
