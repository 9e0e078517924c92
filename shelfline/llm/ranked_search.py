"""Ranked lexical search, term at a time with a limited set of accumulators.

Postings of the items' terms are stored once.  Each item then takes its terms rarest first, a
doubling number of them per step.  A step's postings open accumulators and add to them; once the
bounds of an item's remaining terms together stay below its kth partial score, no document without
an accumulator can come in, and no more are opened.  From there on only accumulators that can still
reach the kth partial score are updated, exactly, with all remaining terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.tables import columns, small, stored_small
from shelfline.llm.words import MARKS, find_words, hash_words, slices, text_column
from shelfline.session import hand_over

KEPT = 10
FIRST_TERMS = 4  # terms of an item in the first step; each step doubles them


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    """(row, key, term, tf, n): a row per text without a term, and one per distinct term of it.

    `row` numbers the texts of each task, so store the result before reading it twice; `n` counts
    all terms of the text.  Terms are 64-bit hashes of letters, digits and all beyond ASCII, with
    A-Z lower-cased.  A NULL text has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", key, "term", "tf", "n"]
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = batch.column(0)
            for part in slices(text_column(batch), lower=True):
                words = find_words(part, MARKS)
                hashes, document = hash_words(part, words), words.document
                order = np.lexsort((hashes, document))
                hashes, document = hashes[order], document[order]
                fresh = np.ones(len(hashes), bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
                at = np.flatnonzero(fresh)
                tf = np.diff(np.append(at, len(hashes)))
                own, sizes = document[at], words.counts
                rows = np.arange(number, number + part.rows)
                number += part.rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows),
                        keys.slice(part.first, part.rows),
                        pa.nulls(part.rows, pa.int64()),
                        pa.array(np.zeros(part.rows, np.int64)),
                        pa.array(sizes),
                    ],
                    names,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[own]),
                        pa.nulls(len(own), keys.type),
                        pa.array(hashes[at].view(np.int64)),
                        pa.array(tf),
                        pa.array(sizes[own]),
                    ],
                    names,
                )

    given = columns(texts, [key, "text"])
    kind = given.schema[key].dataType.simpleString()
    return given.mapInArrow(run, f"row bigint, `{key}` {kind}, term bigint, tf bigint, n bigint")


def store_postings(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Store `term_counts` of all documents, of the terms in `vocabulary` (term)."""
    counts = term_counts(documents, "doc_id")
    kept = counts.join(vocabulary.withColumn("known", F.lit(True)), "term", "left")
    return hand_over(
        kept.where(F.col("term").isNull() | F.col("known")).select(
            "row", "doc_id", "term", "tf", "n"
        ),
        "postings",
    )


def weigh_postings(postings: DataFrame) -> tuple[DataFrame, int]:
    """(row, term, impact) of every posting, and the number of documents with a term."""
    total = postings.where("term IS NULL AND n > 0").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").alias("terms")
    ).first()
    texts, terms = total["texts"], total["terms"] or 1
    length = F.expr(f"25 + (75 * n * {texts}L) div {terms}L")
    impact = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    found = postings.where(F.col("term").isNotNull()).withColumn("m", length)
    return found.select("row", "term", impact.alias("impact")), texts


def plan_terms(items: DataFrame, impacts: DataFrame, texts: int) -> DataFrame:
    """(item, term, weight, position, rest, before): an item's terms rarest first, each with its
    weight times its repeats, the most that all later terms can add, and that with its own."""
    stats = impacts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.max("impact").alias("most")
    )
    rarity = F.log(F.lit(float(2 * texts + 2)) / (2 * F.col("df") + 1).cast("double"))
    weight = F.floor(1000 * rarity).cast("bigint") * F.col("tf")
    first = Window.partitionBy("item").orderBy("df", "term")
    later = first.rowsBetween(1, Window.unboundedFollowing)
    bound = F.col("weight") * F.col("most")
    rest = F.coalesce(F.sum(bound).over(later), F.lit(0))
    return (
        items.join(stats, "term")
        .withColumn("weight", weight)
        .where("weight > 0")
        .select(
            "item",
            "term",
            "weight",
            F.row_number().over(first).alias("position"),
            rest.alias("rest"),
            (rest + bound).alias("before"),
        )
    )


def _kth(scores: DataFrame, kept: int) -> DataFrame:
    """(item, kth) of the items with `kept` accumulators."""
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), "row")
    top = scores.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= kept)
    return top.groupBy("item").agg(
        F.min("score").alias("kth"), F.count(F.lit(1)).alias("_found")
    ).where(F.col("_found") == kept).drop("_found")


def _open_accumulators(
    impacts: DataFrame, plan: DataFrame, terms: int, kept: int, first_terms: int
) -> DataFrame:
    """(item, row, score, done): accumulators that can reach the first `kept`, and the number of
    their item's terms that are in the score."""
    closed: list[DataFrame] = []
    scores, begin, end = None, 0, first_terms
    waiting = plan.withColumn("kth", F.lit(0).cast("bigint"))
    while True:
        # A term before which the bounds have fallen below the kth score opens nothing.
        step = waiting.where(
            (F.col("position") > begin) & (F.col("position") <= end) & (F.col("before") >= F.col("kth"))
        )
        added = impacts.join(small(step, terms), "term").select(
            "item", "row", (F.col("weight") * F.col("impact")).alias("score")
        )
        if scores is not None:
            added = scores.unionByName(added)
        scores = hand_over(added.groupBy("item", "row").agg(F.sum("score").alias("score")), "scores")
        taken = step.groupBy("item").agg(
            F.min("rest").alias("rest"), F.max("position").alias("done")
        )
        state = hand_over(
            taken.join(_kth(scores, kept), "item", "left")
            .withColumn("kth", F.coalesce("kth", F.lit(0)))
            .withColumn("open", (F.col("rest") > 0) & (F.col("rest") >= F.col("kth"))),
            "items",
        )
        rows = state.count()
        ready = small(state.where("NOT open").drop("open"), rows)
        closed.append(
            scores.join(ready, "item")
            .where(F.col("score") + F.col("rest") >= F.col("kth"))
            .select("item", "row", "score", "done")
        )
        if state.where("open").isEmpty():
            return reduce(DataFrame.unionByName, closed)
        still = small(state.where("open").select("item", "kth"), rows)
        scores = scores.join(still, "item", "left_semi")
        waiting = waiting.drop("kth").join(still, "item")
        begin, end = end, 2 * end


def search(
    documents: DataFrame, items: DataFrame, kept: int = KEPT, first_terms: int = FIRST_TERMS
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `kept` best documents with a score above 0.

    A row of `documents` is a document, also where numbers or texts repeat; equal rows of `items`
    are answered once, and items that share a number but not a text apart.  A NULL or empty text
    has no terms; a NULL doc_id comes first among equal scores, repeated ones take any order.  No
    documents or no items give no rows; other columns are dropped.
    """
    asked = hand_over(
        term_counts(columns(items, ["item_id", "text"]).distinct(), "item_id"), "items"
    )
    wanted = asked.where(F.col("term").isNotNull()).withColumnRenamed("row", "item")
    vocabulary = stored_small(wanted.select("term").distinct(), "vocabulary")
    postings = store_postings(documents, vocabulary)
    impacts, texts = weigh_postings(postings)
    plan = hand_over(plan_terms(wanted.select("item", "term", "tf"), impacts, texts), "plan")
    terms = plan.count()
    found = hand_over(
        _open_accumulators(impacts, plan, terms, kept, first_terms), "accumulators"
    )
    rows = found.count()
    missing = found.join(small(plan.drop("rest", "before"), terms), "item").where("position > done")
    own = small(found.select("row").distinct(), rows)
    more = (
        impacts.join(own, "row", "left_semi")
        .join(missing.select("item", "row", "term", "weight"), ["row", "term"])
        .select("item", "row", (F.col("weight") * F.col("impact")).alias("score"))
    )
    scores = hand_over(
        found.select("item", "row", "score")
        .unionByName(more)
        .groupBy("item", "row")
        .agg(F.sum("score").alias("score")),
        "whole",
    )
    keys = postings.where(F.col("term").isNull()).select("row", "doc_id")
    order = Window.partitionBy("item").orderBy(
        F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "row"
    )
    best = (
        keys.join(small(scores.where("score > 0"), rows), "row")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= kept)
    )
    names = asked.where(F.col("term").isNull()).select(F.col("row").alias("item"), "item_id")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
