"""License scan by diagonal voting.

Every run of GRAM words of a text is looked up among the templates' runs.  A hit at text place p
and template place t votes for the diagonal p - t; neighbouring diagonals (a word added or lost)
are merged, and a span stands when enough of the template's runs were seen in a stretch of about
the template's length.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.license_texts import PHRASES, TEMPLATES
from shelfline.llm.tables import columns
from shelfline.llm.words import (
    MARKS,
    Slice,
    find_words,
    hash_runs,
    hash_words,
    slices,
    text_column,
)
from shelfline.session import hand_over

GRAM = 3
MOST_RUNS = 100_000  # runs of all templates that go to every task; more are joined by shuffle
DRIFT = 8  # diagonals of one match lie this close together
LEAST_SHARE = 0.6  # of a template's runs
PARTS = 1 << 20  # of the places that a stretch may cover

Templates = Mapping[str, Sequence[str]]


def _runs(texts: Sequence[str], length: int) -> Iterator[tuple[int, int, int]]:
    """(text number, place, hash) of every run of words; hashes as signed numbers."""
    column = pa.array(list(texts), pa.large_string())
    for part in slices(column, lower=True):
        words = find_words(part, MARKS)
        begin, runs = hash_runs(hash_words(part, words), words, length)
        document, place = words.document, words.place
        for at, run in zip(begin.tolist(), runs.view(np.int64).tolist()):
            yield part.first + int(document[at]), int(place[at]), run


def template_runs(
    spark: SparkSession, templates: Templates, most_runs: int = MOST_RUNS
) -> tuple[DataFrame, np.ndarray | None]:
    """(run, label, template, at, runs): the place of every run of every template; and the runs
    themselves, or None where there are more than `most_runs`: those are a stored table."""
    names = [(label, text) for label, texts in templates.items() for text in texts]
    found = list(_runs([text for _, text in names], GRAM))
    sizes = np.bincount([n for n, _, _ in found], minlength=len(names))
    rows = [(run, names[n][0], n, at, int(sizes[n])) for n, at, run in found]
    runs = spark.createDataFrame(
        rows, "run bigint, label string, template int, at int, runs int"
    )
    if len(found) > most_runs:
        return hand_over(runs, "template-runs"), None
    return F.broadcast(runs), np.unique(np.array([r for r, *_ in rows], np.int64))


def _phrases(phrases: Mapping[str, str]) -> list[tuple[int, int, str]]:
    """(words, hash, label) of each phrase."""
    out = []
    for text, label in phrases.items():
        length = len(text.split())
        out += [(length, run, label) for _, _, run in _runs([text], length)]
    return out


def _scan_slice(part: Slice, known: np.ndarray | None, phrases) -> tuple[list, ...]:
    words = find_words(part, MARKS)
    hashes, document, place = hash_words(part, words), words.document, words.place
    count = np.zeros(part.rows, np.int64)
    first = np.full(part.rows, np.iinfo(np.int64).max)
    last = np.full(part.rows, -1)
    labels: list[set] = [set() for _ in range(part.rows)]
    runs_of = {length: hash_runs(hashes, words, length) for length in {GRAM, *(p[0] for p in phrases)}}
    for length, wanted, label in phrases:
        begin, runs = runs_of[length]
        at = begin[runs.view(np.int64) == wanted]
        np.add.at(count, document[at], 1)
        np.minimum.at(first, document[at], place[at])
        np.maximum.at(last, document[at], place[at])
        for row in np.unique(document[at]).tolist():
            labels[row].add(label)
    begin, runs = runs_of[GRAM]
    runs = runs.view(np.int64)
    if known is not None:
        at = np.minimum(np.searchsorted(known, runs), max(len(known) - 1, 0))
        hit = known[at] == runs if len(known) else np.zeros(len(runs), bool)
        begin, runs = begin[hit], runs[hit]
    bounds = np.searchsorted(begin, words.first)
    hits = [
        [{"run": r, "place": p} for r, p in zip(runs[a:b].tolist(), place[begin[a:b]].tolist())]
        for a, b in zip(bounds[:-1], bounds[1:])
    ]
    none = count == 0
    return (
        pa.array(words.counts.astype(np.int64)),
        pa.array(count),
        pa.array(first, mask=none),
        pa.array(last, mask=none),
        pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
        pa.array(hits, pa.list_(pa.struct([("run", pa.int64()), ("place", pa.int64())]))),
    )


def word_hits(
    documents: DataFrame, known: np.ndarray | None, phrases: Mapping[str, str]
) -> DataFrame:
    """Per row the base columns and its hits; a run that is not `known` is left out at once."""
    wanted = _phrases(phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(text_column(batch), lower=True):
                own = batch.slice(part.first, part.rows).columns[:2]
                yield pa.RecordBatch.from_arrays(
                    [*own, *_scan_slice(part, known, wanted)],
                    ["doc_id", "row_key", "n_words", "n_base", "first_word", "last_word",
                     "base", "hits"],
                )

    rows = columns(documents, ["doc_id", "text"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    # Equal rows share a key: they have equal results.
    keyed = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return keyed.mapInArrow(
        scan,
        f"doc_id {kind}, row_key bigint, n_words bigint, n_base bigint, first_word bigint, "
        "last_word bigint, base array<string>, hits array<struct<run:bigint,place:bigint>>",
    )


def most_places(runs: Column) -> Column:
    """How far apart a stretch's first and last place may be: not much more than the template."""
    return F.floor(1.5 * runs + DRIFT)


def vote(hits: DataFrame, runs: DataFrame, drift: int = DRIFT) -> DataFrame:
    """(doc_id, row_key, label, template, runs, first, last, seen, share) of the merged stretches.

    `hits` has (doc_id, row_key, run, place).  Diagonals in order of their number form one stretch
    as long as the next is at most `drift` away.  One that is longer than a match can be, as of
    notices that follow each other, is cut anew from each of its places on, so that none is missed.
    """
    row = ["doc_id", "row_key", "label", "template", "runs"]
    votes = hits.join(runs, "run").withColumn(
        "diagonal", F.col("place") - F.col("at")
    )
    order = Window.partitionBy(*row).orderBy("diagonal", "place")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > drift
    stretch = F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order)
    limit = most_places(F.col("runs"))
    whole = Window.partitionBy(*row, "stretch")
    # Places in parts of the limit, which differs by template; exact below half of PARTS.
    scaled = F.floor(F.col("place") * PARTS / limit).cast("bigint")
    near = whole.orderBy("scaled").rangeBetween(0, PARTS + 1)
    first, last = F.min("place").over(whole), F.max("place").over(whole)
    return (
        votes.withColumn("stretch", stretch)
        .withColumn("scaled", scaled)
        .withColumn("begins", (F.col("place") == first) | (last - first > limit))
        .withColumn("first", F.col("place"))
        .withColumn("last", F.max("place").over(near))
        .withColumn("seen", F.size(F.collect_set("at").over(near)))
        .where("begins")
        .select(*row, "first", "last", "seen", (F.col("seen") / F.col("runs")).alias("share"))
        .distinct()
    )


def scan_licenses(
    documents: DataFrame,
    templates: Templates = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    least_share: float = LEAST_SHARE,
    most_runs: int = MOST_RUNS,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score per row.

    The score is the largest share of a template that was verified, and at least 0.5 where a base
    phrase stands.  A NULL or empty text has no words, empty labels and score 0.  Repeated rows
    each give a row, an empty table stays empty, other columns are dropped.
    """
    spark = documents.sparkSession
    runs, known = template_runs(spark, templates, most_runs)
    scanned = hand_over(word_hits(documents, known, phrases), "license-hits")
    hits = scanned.select("doc_id", "row_key", F.explode(F.array_distinct("hits")).alias("hit"))
    spans = vote(hits.distinct().select("doc_id", "row_key", "hit.*"), runs)
    # A verified stretch is not much longer than the template: votes far apart are chance.
    verified = spans.where(
        (F.col("share") >= least_share)
        & (F.col("last") - F.col("first") <= most_places(F.col("runs")))
    )
    found = verified.groupBy(
        F.col("doc_id").alias("found_id"), F.col("row_key").alias("found_key")
    ).agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (
        F.col("row_key") == F.col("found_key")
    )
    base = F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    none = F.array().cast("array<string>")
    return scanned.join(found, same, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_union("base", F.coalesce("found", none))), ","
        ).alias("labels"),
        F.greatest(F.coalesce(F.col("share"), F.lit(0.0)), base).alias("score"),
    )
