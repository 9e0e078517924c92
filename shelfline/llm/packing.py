"""Best-fit packing of tokenized documents, certified by lower bounds.

Pieces are dealt to groups of bounded size; each is packed by best-fit decreasing.  Dual-feasible
functions bound the bins of all pieces from below.  Where the groups together use more, all bins
that are not full give up their pieces; those are dealt anew to groups twice as large, up to a
bound, and packed again, until the bins meet the bound, one group holds all that is left, or several
deals in a row save no bin.  Groups that meet their own bound keep only full
bins too: what is left over in many small groups adds up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.tables import columns
from shelfline.llm.tokens import RANKS, VOCABULARY, Encoder, added_tokens
from shelfline.llm.words import text_column
from shelfline.session import hand_over

CAPACITY = 2048
END = 0  # the id behind each document
GROUP_ROWS = 8192  # pieces that one task packs
LARGEST = 16  # times GROUP_ROWS that a group may grow to
PATIENCE = 4  # deals in a row that may save nothing
ROWS_AT_ONCE = 1000


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, what is over comes first."""
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def tokenize(
    documents: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    ranks: str = RANKS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, lot) of every piece of every row.

    Only documents of more than `capacity` ids are cut.  `lot` numbers a task's pieces, so they
    can be dealt evenly whatever the keys.  The files' folder must be the same on all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lot = None, 0
        for batch in batches:
            encoder = encoder or Encoder(vocabulary, ranks, added)
            texts = text_column(batch)
            for first in range(0, len(texts), ROWS_AT_ONCE):
                row, found = [], []
                for number, text in enumerate(texts.slice(first, ROWS_AT_ONCE)):
                    ids = np.append(encoder.ids(text.as_py()), np.uint32(END))
                    data = ids.astype("<u4").tobytes()
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        row.append(first + number)
                        found.append((piece, start, length, crc))
                numbers = np.array(found, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(numbers[:, 0].astype(np.int32)),
                        *(pa.array(numbers[:, i]) for i in (1, 2, 3)),
                        pa.array(np.arange(lot, lot + len(row))),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "lot"],
                )
                lot += len(row)

    added = added_tokens(vocabulary)
    rows = columns(documents, ["doc_id", "text"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, lot bigint",
    )


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the room left in each bin, by best-fit decreasing."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # sorted rooms that some open bin has
    open_bins: dict[int, list[int]] = {}
    left: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        at = bisect_left(rooms, length)
        if at == len(rooms):
            number, room = len(left), capacity
            left.append(capacity)
        else:
            room = rooms[at]
            number = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
        bins[item], offsets[item] = number, capacity - room
        left[number] = room = room - length
        if room:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append(number)
    return bins, offsets, np.array(left, np.int64)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins of any packing: the best of two families of dual-feasible functions.

    One raises pieces over capacity - e to full and drops those below e, for every e up to half;
    the other rounds to multiples of capacity / k.  Pieces that fit before still do after.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length."""
    size = np.arange(capacity + 1)
    many = np.concatenate([[0], np.cumsum(count)])
    mass = np.concatenate([[0], np.cumsum(count * size)])
    e = np.arange(capacity // 2 + 1)
    high = capacity - e
    total = (mass[high + 1] - mass[e]) + capacity * (many[-1] - many[high + 1])
    best = -(-int(total.max()) // capacity)
    for k in range(2, 21):
        scaled = (k + 1) * size
        # In units of capacity / k; a size that is a multiple of capacity / (k + 1) stays itself.
        rounded = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((count * rounded).sum()) // (k * capacity)))
    return best


def _pack_groups(dealt: DataFrame, capacity: int, number: int) -> DataFrame:
    """Pack each group: adds sequence_id, offset, and whether the bin is given up."""

    def pack(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy()
        bins, offsets, left = best_fit(lengths, capacity)
        given_up = left > 0
        name = (number << 48) + (group["deal"][0].as_py() << 20)
        out = group.append_column("sequence_id", pa.array(name + bins))
        out = out.append_column("offset", pa.array(offsets))
        return out.append_column("given_up", pa.array(given_up[bins]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.groupBy("deal").applyInArrow(
        pack, f"{kinds}, sequence_id bigint, offset bigint, given_up boolean"
    )


def least_bins_of_all(pieces: DataFrame, capacity: int) -> int:
    """The bound of all pieces, from the number of pieces of each length."""
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    count = np.zeros(capacity + 1, np.int64)
    for row in sizes:
        count[row["length"]] = row["n"]
    return bound_of_counts(count, capacity)


def pack_pieces(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
    patience: int = PATIENCE,
) -> DataFrame:
    """Add sequence_id and offset to (length, lot, ...); pass a stored table.

    Every piece of 1 to `capacity` ids gets a place; sequences have no gaps and no overlaps.  A
    deal that saves no bin is dropped for the one before; `patience` of them in a row end the
    exchange, and so do the bound of all pieces and a single group.
    """
    names, bound = pieces.columns, least_bins_of_all(pieces, capacity)
    done: list[DataFrame] = []
    rest, last, last_bins, closed = pieces, None, 0, 0
    number, idle, size = 0, 0, group_rows
    while True:
        rows = rest.count()
        groups = max(1, -(-rows // size))
        # The first deal is even; later ones mix the pieces anew.
        lot = F.col("lot") if not number else F.abs(F.xxhash64("lot", F.lit(number)) % 2147483647)
        dealt = rest.withColumn("deal", F.pmod(lot, F.lit(groups)).cast("bigint"))
        packed = hand_over(
            _pack_groups(dealt, capacity, number).drop("deal"), f"packed-{number}"
        )
        number, size = number + 1, min(2 * size, LARGEST * group_rows)
        # Every bin has one piece at its begin.
        opened = {r[0]: r[1] for r in packed.where("offset = 0").groupBy("given_up").count().collect()}
        bins = sum(opened.values())
        if last is not None and bins >= last_bins:
            idle += 1
            if groups == 1 or idle >= patience:
                break
            continue
        idle = 0
        if closed + bins <= bound or groups == 1:
            last = packed
            break
        closed += opened.get(False, 0)
        done.append(packed.where("NOT given_up"))
        last, last_bins = packed.where("given_up"), opened.get(True, 0)
        rest = last.select(*names)
    return reduce(DataFrame.unionAll, [*done, last]).select(*names, "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bins, least_bins): the sequences used and the bound that no packing of the pieces beats."""
    bound = least_bins_of_all(packed, capacity)
    return packed.agg(
        F.count_if(F.col("offset") == 0).alias("bins"), F.lit(bound).cast("bigint").alias("least_bins")
    )


def pack_documents(
    documents: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A NULL or empty text is a document of the end id alone.  Repeated rows are packed each, an
    empty table stays empty, other columns are dropped.
    """
    pieces = hand_over(tokenize(documents, capacity), "pieces")
    return pack_pieces(pieces, capacity, group_rows).drop("lot")
