"""Approximate nearest neighbours: inverted lists, scanned dimension by dimension.

Vectors are turned by a random rotation, dealt to the list of their nearest centroid and stored in
blocks of columns.  A query probes the lists of its nearest centroids.  Inside a list its distance
to all rows grows block by block; after each block a row is abandoned if, by the hypothesis test
that its whole distance is below the kth found so far, its partial one is too long.  What is left
is measured on the original vectors.  Centroids and the number of probes come from a bounded
sample; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.tables import columns
from shelfline.session import hand_over

KEPT = 10
QUERY_EVERY = 100  # fixed value: vec_ids divisible by it are queries
SAMPLE_ROWS = 8192  # rows that centroids and probes are fitted on, at most
SAMPLE_VALUES = 1 << 22  # and their components
LIST_ROWS = 512  # rows per list that are aimed at
MOST_LISTS = 512
PART_ROWS = 4096  # rows of a list, or queries of one, that a task takes
WIDTH = 16  # dimensions of a block of columns
RIGOUR = 2.1  # how many deviations a partial distance may be off
COVERED = 0.97  # share of a sample's neighbours that the probed lists must hold
SEED = 20


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part: not NULL, not zero, no NULL
    or non-finite component, and as long as most of them (the longer at a tie)."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = columns(embeddings, ["vec_id", "embedding"]).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("embedding")
    )
    sound = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    lengths = sound.groupBy(F.size("embedding").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("length")).select("length").limit(1)
    return sound.where(F.size("embedding") == usual.scalar())


@dataclass
class Lists:
    """What the sample gives: the rotation, the lists' centroids (rotated), probes per query."""

    turn: np.ndarray
    centroids: np.ndarray
    probes: int

    def nearest(self, rotated: np.ndarray) -> np.ndarray:
        """Squared distance to every centroid, less the vector's own square."""
        return (self.centroids**2).sum(1) - 2 * rotated @ self.centroids.T


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _centroids(sample: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """k-means; a list that loses all its rows starts again at a random one."""
    random = np.random.default_rng(SEED)
    centroids = sample[random.choice(len(sample), count, replace=False)]
    for _ in range(rounds):
        near = ((centroids**2).sum(1) - 2 * sample @ centroids.T).argmin(1)
        rows = np.bincount(near, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        lost = rows == 0
        centroids = sums / np.maximum(rows, 1)[:, None]
        centroids[lost] = sample[random.choice(len(sample), int(lost.sum()))]
    return centroids


def _probes(sample: np.ndarray, centroids: np.ndarray, kept: int, tried: int = 256) -> int:
    """Lists that must be probed so that they hold COVERED of the sample's own neighbours."""
    own = ((centroids**2).sum(1) - 2 * sample @ centroids.T).argmin(1)
    asked = sample[:tried]
    distances = (sample**2).sum(1) - 2 * asked @ sample.T
    distances[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(distances, axis=1)[:, : min(kept, len(sample) - 1)]
    if not near.size:
        return 1
    order = np.argsort((centroids**2).sum(1) - 2 * asked @ centroids.T, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(COVERED * len(needed)))]) + 1


def fit_lists(vectors: DataFrame, kept: int = KEPT) -> Lists | None:
    """Fit on at most SAMPLE_ROWS rows, chosen by hash; None without rows."""
    rows = vectors.count()
    if not rows:
        return None
    length = vectors.select(F.size("embedding")).first()[0]
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // length))
    draw = F.xxhash64("vec_id", "embedding")
    # Twice as many as needed, so that no task sends a whole sample of its own.
    share = min(1.0, 2 * most / rows)
    likely = F.pmod(draw, F.lit(1 << 30)) <= int(share * (1 << 30))
    taken = vectors.where(likely).orderBy(draw, "vec_id").limit(most).select("embedding").toArrow()
    sample = matrix(taken["embedding"], length)
    random = np.random.default_rng(SEED)
    turn = np.linalg.qr(random.normal(size=(length, length)))[0]
    sample = sample @ turn
    count = int(min(MOST_LISTS, max(1, rows // LIST_ROWS), max(1, len(sample) // 16)))
    centroids = _centroids(sample, count)
    return Lists(turn, centroids, _probes(sample, centroids, kept))


def _lists_of(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(values).ravel())


def index_vectors(vectors: DataFrame, lists: Lists) -> DataFrame:
    """Store (row, vec_id, list, embedding, d0, d16, ...): every vector, rotated in blocks of
    columns, with its list."""
    length = len(lists.turn)
    starts = range(0, length, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            rotated = matrix(batch.column(1), length) @ lists.turn
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + len(rotated))),
                    batch.column(0),
                    pa.array(lists.nearest(rotated).argmin(1).astype(np.int32)),
                    batch.column(1),
                    *(_lists_of(rotated[:, at : at + WIDTH]) for at in starts),
                ],
                ["row", "vec_id", "list", "embedding", *(f"d{at}" for at in starts)],
            )
            number += len(rotated)

    blocks = ", ".join(f"d{at} array<double>" for at in starts)
    schema = f"row bigint, vec_id bigint, list int, embedding array<double>, {blocks}"
    return hand_over(vectors.mapInArrow(run, schema), "vectors")


def _probed(queries: DataFrame, lists: Lists, sizes: np.ndarray, kept: int) -> DataFrame:
    """(query, vector, list, turn): the lists that each query probes, the nearest first; more
    than usual while they hold fewer than `kept` other rows."""
    length = len(lists.turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(lists.nearest(matrix(batch.column(1), length) @ lists.turn), axis=1)
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            wanted = (np.arange(len(sizes)) < lists.probes) | (before <= kept)
            row, turn = np.nonzero(wanted)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    taken.column(0),
                    taken.column(1),
                    pa.array(order[row, turn].astype(np.int32)),
                    pa.array(turn.astype(np.int32)),
                ],
                ["query", "vector", "list", "turn"],
            )

    return queries.select(F.col("row").alias("query"), F.col("embedding").alias("vector")).mapInArrow(
        run, "query bigint, vector array<double>, list int, turn int"
    )


def scan(
    query: np.ndarray,
    rotated: np.ndarray,
    blocks: list[np.ndarray],
    vectors: np.ndarray,
    skip: np.ndarray,
    limit: float,
    names: np.ndarray,
    kept: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the `kept` nearest rows, ties to smaller `names`.

    The first rows are measured whole; their kth distance, or `limit` if that is less, is what the
    others are tested against after each block of columns.
    """
    length = vectors.shape[1]

    def measure(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = vectors[rows] - query
        distances = np.sqrt((apart * apart).sum(axis=1))
        best = np.lexsort((names[rows], distances))[:kept]
        return rows[best], distances[best]

    open_rows = np.flatnonzero(~skip)
    first, rest = open_rows[: 8 * kept], open_rows[8 * kept :]
    found, distances = measure(first)
    if len(found) == kept:
        limit = min(limit, distances[-1])
    partial, seen = np.zeros(len(rest)), 0
    for block in blocks:
        if not len(rest):
            break
        width = block.shape[1]
        apart = block[rest] - rotated[seen : seen + width]
        partial += np.einsum("ij,ij->i", apart, apart)
        seen += width
        if seen < length:
            slack = 1 + RIGOUR / np.sqrt(seen)
            keep = partial <= limit * limit * (seen / length) * slack * slack
        else:
            # The rotation's own rounding must not cost a tie.
            keep = partial <= limit * limit * (1 + 1e-9)
        rest, partial = rest[keep], partial[keep]
    return measure(np.concatenate([found, rest]))


def _scan_lists(
    index: DataFrame,
    probes: DataFrame,
    lists: Lists,
    sizes: np.ndarray,
    kept: int,
    part_rows: int,
) -> DataFrame:
    """(query, row, vec_id, score): the nearest rows of each part of each probed list.

    `probes` has (query, vector, list, limit).  Long lists are cut into parts and many queries of
    a list into chunks, so a task holds `part_rows` of each, on average.
    """
    length = len(lists.turn)
    starts = range(0, length, WIDTH)
    asked = np.zeros(len(sizes), np.int64)
    for row in probes.groupBy("list").count().collect():  # one row per list
        asked[row["list"]] = row["count"]
    cuts = index.sparkSession.createDataFrame(
        [
            (n, max(1, -(-int(size) // part_rows)), -(-int(asked[n]) // part_rows))
            for n, size in enumerate(sizes)
            if asked[n]
        ],
        "list int, parts int, chunks int",
    )
    cuts = F.broadcast(cuts)  # one row per list
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    share = lambda name, count: F.pmod(F.xxhash64(name), F.col(count)).cast("int")
    rows = (
        index.join(cuts, "list")
        .withColumn("part", share("row", "parts"))
        .withColumn("chunk", each("chunks"))
        .drop("parts", "chunks")
    )
    queries = (
        probes.join(cuts, "list")
        .withColumn("chunk", share("query", "chunks"))
        .withColumn("part", each("parts"))
        .drop("parts", "chunks")
    )

    def pairs(found: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if found.num_rows and wanted.num_rows:
            vectors = matrix(found["embedding"], length)
            blocks = [matrix(found[f"d{at}"], min(WIDTH, length - at)) for at in starts]
            row, vec_id = found["row"].to_numpy(), found["vec_id"].to_pandas().to_numpy(float)
            names = np.lexsort((row, vec_id))  # a NULL vec_id comes last
            names[names] = np.arange(len(names))
            asking = matrix(wanted["vector"], length)
            turned, limits = asking @ lists.turn, wanted["limit"].to_numpy()
            for n, query in enumerate(wanted["query"].to_numpy()):
                at, score = scan(
                    asking[n], turned[n], blocks, vectors, row == query, limits[n], names, kept
                )
                out[0].append(np.full(len(at), query))
                out[1].append(row[at])
                out[2].append(at)
                out[3].append(score)
        if not out[0]:
            kinds = [("query", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64())]
            return pa.schema([*kinds, ("score", pa.float64())]).empty_table()
        query, row_, at, score = (np.concatenate(c) for c in out)
        return pa.table(
            {"query": query, "row": row_, "vec_id": found["vec_id"].take(at), "score": score}
        )

    key = ["list", "part", "chunk"]
    return (
        rows.groupBy(*key)
        .cogroup(queries.groupBy(*key))
        .applyInArrow(pairs, "query bigint, row bigint, vec_id bigint, score double")
    )


def _nearest(found: DataFrame, kept: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def nearest_neighbours(
    embeddings: DataFrame,
    kept: int = KEPT,
    query_every: int = QUERY_EVERY,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score, the Euclidean distance, of each query's `kept` nearest
    rows found.

    Queries are the rows whose vec_id is divisible by `query_every`, candidates all others.  Rows
    are told apart also where numbers or vectors repeat, so a number may be asked twice and found
    beside itself; a NULL vec_id is no query and comes last among ties.  Vectors that are NULL,
    zero, of another length than most or with a NULL or non-finite component take no part.  With
    fewer other rows a query has as many neighbours; an empty table gives none.
    """
    vectors = usable_vectors(embeddings)
    lists = fit_lists(vectors, kept)
    if lists is None:
        return vectors.limit(0).select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        )
    index = index_vectors(vectors, lists)
    sizes = np.zeros(len(lists.centroids), np.int64)
    for row in index.groupBy("list").count().collect():  # one row per list
        sizes[row["list"]] = row["count"]
    queries = index.where(F.col("vec_id") % query_every == 0)
    probes = hand_over(_probed(queries, lists, sizes, kept), "probes")
    # The nearest list first, so that the others are scanned against its kth distance.
    first = probes.where("turn = 0").withColumn("limit", F.lit(float("inf")))
    begun = hand_over(_nearest(_scan_lists(index, first, lists, sizes, kept, part_rows), kept), "nearest")
    limits = begun.where(F.col("rank") == kept).select("query", F.col("score").alias("limit"))
    others = (
        probes.where("turn > 0")
        .join(limits, "query", "left")
        .withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    )
    others = hand_over(others, "probes")
    rest = _scan_lists(index, others, lists, sizes, kept, part_rows)
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return (
        _nearest(begun.drop("rank").unionByName(rest), kept)
        .join(names, "query")
        .select("query_id", "rank", "vec_id", "score")
    )
