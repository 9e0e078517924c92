"""N-gram Jaccard join by vertical partitioning.

Documents with equal sets of word n-grams are one class, found by a signature of the set; all
else works on classes.  The join finds every pair of classes that a class could link with, and no
pair is left unchecked unless both its ends already hang together:

1. A class must share enough of the first n-grams of its set (in the order of their hashes) with
   others.  Blocks of documents send those n-grams, cut into fragments, to be met by the other
   blocks'; an n-gram that a block holds twice is sent once, so a common one stays small.
2. The few classes left are read again.  Their n-grams are ordered from the rarest on; two classes
   that link share one of their first n-grams (prefix filter).
3. Each such n-gram's classes are compared with its hub, the class with the fewest n-grams of its
   own; then what does not hang together with the hub is compared with the rest.
4. A comparison cuts the n-gram order into fragments, counts the overlap in each by itself and
   sums the counts per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.components import connected_components
from shelfline.llm.tables import columns, small, stored_small
from shelfline.llm.words import (
    SPACES,
    Slice,
    find_words,
    hash_runs,
    hash_words,
    mix,
    per_document,
    slices,
    text_column,
)
from shelfline.session import hand_over

WORDS = 4
PERCENT = 85
BLOCK_NGRAMS = 1_000_000  # n-grams that a block gathers before it sends them
FRAGMENTS = 8  # of the n-gram order, in which overlaps are counted
KEYS = ["doc_id", "row_key", "copy"]


def least_overlap(size, percent: int):
    """n-grams that a set must share with any set it links with."""
    return -(-percent * size // 100)


def prefix_length(size, percent: int):
    return size - least_overlap(size, percent) + 1


def ngram_sets(part: Slice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each document's distinct n-grams in ascending order.

    A document with fewer words has one, its whole sequence; one without words has none."""
    found = find_words(part, SPACES)
    hashes = hash_words(part, found)
    begin, runs = hash_runs(hashes, found, words)
    owner = found.document[begin]
    counts = found.counts
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = []
        for row in short.tolist():
            own = found.first[row]
            step = np.arange(counts[row], dtype=np.uint64) + np.uint64(1)
            whole.append(mix(hashes[own : own + counts[row]] * (2 * step + 1)).sum())
        runs = np.concatenate([runs, np.array(whole, np.uint64)])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        runs, owner = runs[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(part.rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        runs[a:b].sort()
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit signature of each set."""
    sums = per_document(mix(hashes * np.uint64(0xA24BAED4963EE407)), bounds)
    return mix(sums + np.diff(bounds).astype(np.uint64)).view(np.int64)


class _Block:
    """The first n-grams of some documents' sets, on their way to the fragments."""

    def __init__(self, number: int, fragments: int):
        self.number, self.fragments = number, fragments
        self.known: set[int] = set()
        self.first: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.size = 0
        self.documents: list[pa.RecordBatch] = []

    def add(self, keys: list[pa.Array], part: Slice, words: int, percent: int) -> None:
        hashes, bounds = ngram_sets(part, words)
        marks, sizes = signatures(hashes, bounds), np.diff(bounds)
        place = np.full(part.rows, -1)
        for row, mark in enumerate(marks.tolist()):
            if sizes[row] and mark not in self.known:
                place[row] = len(self.known)
                self.known.add(mark)
        length = np.minimum(sizes, 2 * prefix_length(sizes, percent) - 1)
        length[place < 0] = 0
        total = int(length.sum())
        at = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        self.first.append(hashes[at + np.repeat(bounds[:-1], length)])
        self.owner.append(np.repeat(place, length))
        self.size += total
        self.documents.append(
            pa.RecordBatch.from_arrays(
                [pa.array(marks), pa.array(sizes.astype(np.int64)), pa.array(place), *keys],
                ["mark", "size", "place", *KEYS],
            )
        )

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Documents, each with its number of n-grams that the block holds twice; then for every
        fragment the n-grams held once, with their owners, and those held more often."""
        first = np.concatenate([*self.first, np.zeros(0, np.uint64)])
        owner = np.concatenate([*self.owner, np.zeros(0, np.int64)])
        order = np.argsort(first)
        first, owner = first[order], owner[order]
        again = np.zeros(len(first), bool)
        same = first[1:] == first[:-1]
        again[1:] |= same
        again[:-1] |= same
        shared = np.bincount(owner[again], minlength=len(self.known))
        for batch in self.documents:
            place = batch.column(2).to_numpy()
            own = np.zeros(len(place), np.int64)
            own[place >= 0] = shared[place[place >= 0]]
            yield _filled(
                schema,
                batch.num_rows,
                **dict(zip(batch.schema.names, batch.columns)),
                shared=pa.array(own),
                block=pa.array(np.full(len(place), self.number)),
            )
        of = (first % np.uint64(self.fragments)).astype(np.int64)
        kinds = [(~again, "once"), (np.append(~same, True) & again, "often")]
        blobs = {"fragment": [], "once": [], "owners": [], "often": []}
        for fragment in range(self.fragments):
            mine = of == fragment
            once, often = (first[mine & kind].astype("<u8").tobytes() for kind, _ in kinds)
            if once or often:
                blobs["fragment"].append(fragment)
                blobs["once"].append(once)
                blobs["owners"].append(owner[mine & ~again].astype("<u4").tobytes())
                blobs["often"].append(often)
        count = len(blobs["fragment"])
        yield _filled(
            schema,
            count,
            block=pa.array(np.full(count, self.number)),
            fragment=pa.array(blobs["fragment"], pa.int32()),
            **{name: pa.array(blobs[name], pa.binary()) for name in ("once", "owners", "often")},
        )


def _filled(schema: pa.Schema, rows: int, **found: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            found[f.name].cast(f.type) if f.name in found else pa.nulls(rows, f.type)
            for f in schema
        ],
        schema=schema,
    )


def row_hashes() -> list[Column]:
    """A row by hashes of key and text and of the text alone: never NULL, equal for equal rows."""
    return [F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64("text").alias("copy")]


def send_first_ngrams(
    documents: DataFrame, words: int, percent: int, fragments: int
) -> DataFrame:
    """Documents (keys, mark, size, block, place, shared) and, with a fragment, the blocks'
    n-grams; in one table, so that both come from the same run of a task."""
    rows = columns(documents, ["doc_id", "text"])
    keyed = rows.select("doc_id", *row_hashes(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, schema, block = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            schema = schema or pa.schema(
                [batch.schema.field(0).with_name("doc_id"), *_BLOCK_FIELDS]
            )
            for part in slices(text_column(batch), lower=True):
                block = block or _Block(task << 32 | count, fragments)
                block.add(batch.slice(part.first, part.rows).columns[:3], part, words, percent)
                if block.size >= BLOCK_NGRAMS:
                    yield from block.rows(schema)
                    block, count = None, count + 1
        if block:
            yield from block.rows(schema)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(
        run,
        f"doc_id {kind}, row_key bigint, copy bigint, mark bigint, size bigint, block bigint, "
        "place int, shared bigint, fragment int, once binary, owners binary, often binary",
    )


_BLOCK_FIELDS = [
    pa.field("row_key", pa.int64()),
    pa.field("copy", pa.int64()),
    pa.field("mark", pa.int64()),
    pa.field("size", pa.int64()),
    pa.field("block", pa.int64()),
    pa.field("place", pa.int32()),
    pa.field("shared", pa.int64()),
    pa.field("fragment", pa.int32()),
    pa.field("once", pa.binary()),
    pa.field("owners", pa.binary()),
    pa.field("often", pa.binary()),
]


def _meet(fragment: pa.Table) -> pa.Table:
    """Per block, how many of each document's n-grams of this fragment other blocks hold too."""
    once = [np.frombuffer(x, "<u8") for x in fragment["once"].to_pylist()]
    often = np.concatenate([np.frombuffer(x, "<u8") for x in fragment["often"].to_pylist()])
    first = np.concatenate(once)
    order = np.argsort(first)
    ordered = first[order]
    same = ordered[1:] == ordered[:-1]
    met = np.zeros(len(first), bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    often = np.sort(often)
    if len(often):
        near = np.minimum(np.searchsorted(often, first), len(often) - 1)
        met |= often[near] == first
    counts, at = [], 0
    for own, owners in zip(once, fragment["owners"].to_pylist()):
        hit = met[at : at + len(own)]
        at += len(own)
        counts.append(np.bincount(np.frombuffer(owners, "<u4")[hit]).astype("<u4").tobytes())
    return pa.table({"block": fragment["block"], "counts": pa.array(counts, pa.binary())})


def _total(block: pa.Table) -> pa.Table:
    """(block, place, met) of the documents that met anything, over all fragments."""
    counts = [np.frombuffer(x, "<u4") for x in block["counts"].to_pylist()]
    total = np.zeros(max(map(len, counts)), np.int64)
    for own in counts:
        total[: len(own)] += own
    place = np.flatnonzero(total)
    number = block["block"][0].as_py()
    return pa.table(
        {
            "block": pa.array(np.full(len(place), number)),
            "place": pa.array(place.astype(np.int32)),
            "met": pa.array(total[place]),
        }
    )


def sharing_marks(sent: DataFrame, percent: int) -> DataFrame:
    """(mark) of the classes that share enough of their first n-grams to link at all.

    With p(n) = prefix_length(n), linked sets of sizes n and m have p(m) of their common n-grams
    among the first 2 p - 1 of both, and m is at least least_overlap(n).
    """
    met = (
        sent.where(F.col("fragment").isNotNull())
        .select("fragment", "block", "once", "owners", "often")
        .groupBy("fragment")
        .applyInArrow(_meet, "block bigint, counts binary")
        .groupBy("block")
        .applyInArrow(_total, "block bigint, place int, met bigint")
    )
    documents = sent.where("place >= 0").select("mark", "size", "block", "place", "shared")
    partner = F.ceil(F.col("size") * percent / 100)
    needed = partner - F.ceil(partner * percent / 100) + 1
    return (
        documents.join(met, ["block", "place"], "left")
        .where(F.col("shared") + F.coalesce("met", F.lit(0)) >= needed)
        .select("mark")
        .distinct()
    )


def read_sets(documents: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(mark, size, fragment, ngrams) of the chosen (doc_id, mark), read again.

    A fragment holds the n-grams of one even stretch of the hash order."""
    chosen = small(chosen, chosen.count())
    shift = np.uint64(64 - int(np.log2(FRAGMENTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            for part in slices(text_column(batch), lower=True):
                hashes, bounds = ngram_sets(part, words)
                marks = signatures(hashes, bounds)
                rows = np.flatnonzero(marks == wanted[part.first : part.first + part.rows])
                out: list[list] = [[], [], [], []]
                for row in rows.tolist():
                    own = hashes[bounds[row] : bounds[row + 1]]
                    cuts = np.searchsorted(own >> shift, np.arange(FRAGMENTS + 1))
                    for fragment, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        if a < b:
                            values = (int(marks[row]), len(own), fragment, own[a:b].view(np.int64))
                            for column, value in zip(out, values):
                                column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(out, kinds)],
                    ["mark", "size", "fragment", "ngrams"],
                )

    found = columns(documents, ["doc_id", "text"]).join(chosen, "doc_id").select("mark", "text")
    sets = found.mapInArrow(run, "mark bigint, size bigint, fragment int, ngrams array<bigint>")
    return sets.dropDuplicates(["mark", "fragment"])


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(ngram, mark, size, own, at, reach): the first n-grams of each class, the rarest first.

    `own` n-grams that no other class has come before all others and are left out; `at` is the
    n-gram's place in the whole order and `reach` the largest set the class can link with.
    """
    listed = sets.select("mark", "size", F.explode("ngrams").alias("ngram"))
    common = listed.groupBy("ngram").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    order = Window.partitionBy("mark").orderBy("classes", "ngram")
    own = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("mark"))
    length = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    reach = F.floor(
        ((100 + percent) * (F.col("size") - F.col("own")) - percent * F.col("size")) / percent
    )
    return (
        listed.join(common, "ngram")
        .withColumn("own", own)
        .withColumn("at", F.col("own") + F.row_number().over(order) - 1)
        .where(F.col("at") < length)
        .select("ngram", "mark", "size", "own", "at", reach.alias("reach"))
    )


def _fit(a: str, b: str, percent: int) -> Column:
    """Both ends' sizes, and what is left of them behind the shared n-gram, allow a link."""
    left = F.least(
        F.col(f"{a}.size") - F.col(f"{a}.at"), F.col(f"{b}.size") - F.col(f"{b}.at")
    )
    return (
        (F.col(f"{a}.size") <= F.col(f"{b}.reach"))
        & (F.col(f"{b}.size") <= F.col(f"{a}.reach"))
        & ((100 + percent) * left >= percent * (F.col(f"{a}.size") + F.col(f"{b}.size")))
    )


def _pair(a: str, b: str) -> list[Column]:
    ends = F.col(f"{a}.mark"), F.col(f"{b}.mark")
    return [F.least(*ends).alias("a"), F.greatest(*ends).alias("b")]


def hub_pairs(prefix: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(a, b): every class with the hubs of its n-grams, as far as they could link."""
    members = prefix.alias("x").join(hubs.alias("h"), F.col("x.ngram") == F.col("h.ngram"))
    # The hub's place is not known to be the first common one, so only sizes are compared.
    could = (F.col("x.size") <= F.col("h.hub.reach")) & (F.col("h.hub.size") <= F.col("x.reach"))
    apart = F.col("x.mark") != F.col("h.hub.mark")
    ends = F.col("x.mark"), F.col("h.hub.mark")
    return (
        members.where(apart & could)
        .select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
        .distinct()
    )


def left_pairs(
    prefix: DataFrame, hubs: DataFrame, roots: DataFrame, percent: int
) -> DataFrame:
    """(a, b) of classes that share a first n-gram but hang together with different classes.

    One end of such a pair is not the hub's, so only those classes seek partners."""
    named = prefix.join(
        roots.select(F.col("node").alias("mark"), "root"), "mark", "left"
    ).withColumn("root", F.coalesce("root", "mark"))
    named = hand_over(named, "named")
    hub_roots = hubs.select("ngram", F.col("hub.mark").alias("mark")).join(
        roots.select(F.col("node").alias("mark"), F.col("root").alias("_root")), "mark", "left"
    )
    hub_roots = hub_roots.select("ngram", F.coalesce("_root", "mark").alias("hub_root"))
    seeking = hand_over(named.join(hub_roots, "ngram").where("root != hub_root"), "seeking")
    x, y = seeking.alias("x"), named.alias("y")
    return (
        x.join(
            y,
            (F.col("x.ngram") == F.col("y.ngram"))
            & (F.col("x.root") != F.col("y.root"))
            & _fit("x", "y", percent),
        )
        .select(*_pair("x", "y"))
        .distinct()
    )


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that link: overlaps are counted fragment by fragment and summed."""
    left = sets.select(
        F.col("mark").alias("a"), F.col("size").alias("size_a"), "fragment", F.col("ngrams").alias("x")
    )
    right = sets.select(
        F.col("mark").alias("b"), F.col("size").alias("size_b"), "fragment", F.col("ngrams").alias("y")
    )
    partial = (
        pairs.join(left, "a")
        .join(right, ["b", "fragment"])
        .select("a", "b", "size_a", "size_b", F.size(F.array_intersect("x", "y")).alias("overlap"))
    )
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("overlap").alias("overlap"))
    union = F.col("size_a") + F.col("size_b") - F.col("overlap")
    return total.where(100 * F.col("overlap") >= percent * union).select("a", "b")


def near_duplicates(
    documents: DataFrame, words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, row_key, copy, n_shingles, component_id and root (the component's class) of every
    row; `row_key` and `copy` are hashes of key and text and of the text.

    Documents link when their sets' Jaccard similarity is at least `percent`; a component's id is
    its smallest doc_id.  A NULL or wordless text has no n-grams and is linked with nothing, not
    even with its like; rows without a doc_id are in the class of their set, but a class of only such
    rows is compared with no other.  Repeated rows are in one class; an empty table stays empty; other columns
    are dropped.  Sets are told apart by 64-bit signatures and n-grams by 64-bit hashes.
    """
    fragments = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = hand_over(send_first_ngrams(documents, words, percent, fragments), "first-ngrams")
    rows = sent.where(F.col("fragment").isNull()).select(*KEYS, "mark", "size")
    sized = rows.where("size > 0")
    classes = sized.groupBy("mark").agg(F.min("doc_id").alias("smallest"))
    chosen = classes.join(sharing_marks(sent, percent), "mark")
    chosen = hand_over(chosen.select(F.col("smallest").alias("doc_id"), "mark"), "chosen")
    sets = hand_over(read_sets(documents, chosen, words), "sets")
    prefix = hand_over(prefixes(sets, percent), "prefixes")
    hubs = prefix.groupBy("ngram").agg(
        F.min(F.struct("own", "mark", "size", "reach")).alias("hub"),
        F.count(F.lit(1)).alias("members"),
    )
    # Stored, so that joins with common n-grams read plain exchanges, which Spark splits.
    hubs = hand_over(hubs.where("members > 1").drop("members"), "hubs")
    tried = hand_over(hub_pairs(prefix, hubs, percent), "hub-pairs")
    first = hand_over(linked(tried, sets, percent), "hub-links")
    rest = left_pairs(prefix, hubs, connected_components(first), percent).join(
        tried, ["a", "b"], "left_anti"
    )
    second = linked(hand_over(rest, "left-pairs"), sets, percent)
    roots = connected_components(first.unionByName(second))
    # Stored, so that a component of very many classes is joined over plain exchanges.
    parts = hand_over(
        classes.join(roots.toDF("mark", "root"), "mark", "left").withColumn(
            "root", F.coalesce("root", "mark")
        ),
        "parts",
    )
    smallest = stored_small(
        parts.groupBy("root").agg(F.min("smallest").alias("component")), "smallest"
    )
    named = parts.join(smallest, "root").select(F.col("mark").alias("_mark"), "root", "component")
    return rows.join(
        named, (rows["mark"] == named["_mark"]) & (rows["size"] > 0), "left"
    ).select(
        *KEYS,
        F.col("size").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        "root",
    )


def keep_one_each(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, one with the smallest doc_id, with its own columns.

    A missing doc_id counts as the largest; of a key's texts that are in one component the one with
    the smallest hash stays, of equal rows any one.  Rows without words stay, all of them."""
    found = near_duplicates(documents, words, percent).where("n_shingles > 0")
    members = hand_over(found.select("root", *KEYS), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *KEYS)).alias("first")
    kept = members.groupBy("root").agg(first).select("first.row_key", "first.copy")
    kept = hand_over(kept, "kept")
    rows = members.groupBy("row_key", "copy").agg(F.count(F.lit(1)).alias("rows"))
    gone = stored_small(
        rows.join(kept, ["row_key", "copy"], "left_anti").select(*_hidden()), "copies"
    )
    again = hand_over(rows.where("rows > 1").join(kept, ["row_key", "copy"]), "repeated")
    repeated = again.count()
    given = documents.columns
    hidden = dict(zip(("_row_key", "_copy"), row_hashes()))
    left = documents.withColumns(hidden).join(gone, [*hidden], "left_anti")
    if repeated:
        again = small(again.select(*_hidden()), repeated)
        once = left.join(again, [*hidden], "left_anti")
        left = once.unionByName(
            left.join(again, [*hidden], "left_semi").dropDuplicates([*hidden])
        )
    return left.select(*(F.col(f"`{name}`") for name in given))


def _hidden() -> list[Column]:
    return [F.col(name).alias(f"_{name}") for name in ("row_key", "copy")]
