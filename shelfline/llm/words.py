"""Words of whole Arrow batches as numpy arrays: spans, hashes, shingles, places per document.

Texts stay UTF-8 bytes.  Every class of word used here is a class of bytes (all bytes of a
character beyond ASCII are word bytes), so words of bytes are words of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

LONG_WORD = 512  # bytes; longer ones are hashed one by one

_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# Words of letters and digits: everything else below 0x80 separates.
MARKS = np.ones(256, bool)
MARKS[0x80:] = False
MARKS[0x30:0x3A] = MARKS[0x41:0x5B] = MARKS[0x61:0x7B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers(count: int) -> np.ndarray:
    return np.cumprod(np.full(count, _BASE, np.uint64))


@dataclass
class Slice:
    """Some documents: their bytes one after the other, and where each begins."""

    first: int  # the first document's row in the batch
    data: np.ndarray  # uint8
    bounds: np.ndarray  # document i is data[bounds[i]:bounds[i + 1]]

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large strings; a missing text is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(texts: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices of about `limit` bytes, each of whole documents."""
    count = len(texts)
    if not count:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + count + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < count:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), count)
        part = whole[ends[at] : ends[to]]
        yield Slice(at, LOWER[part] if lower else part, ends[at : to + 1] - ends[at])
        at = to


@dataclass
class Words:
    """The words of a slice in order; `first[i]:first[i + 1]` are those of document i."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def place(self) -> np.ndarray:
        """Each word's number within its document."""
        return np.arange(len(self.begin)) - np.repeat(self.first[:-1], self.counts)


def find_words(part: Slice, separators: np.ndarray) -> Words:
    inside = ~separators[part.data]
    size = len(inside)
    edge = np.zeros(size + 1, bool)
    edge[part.bounds] = True  # no word runs from one document into the next
    before = np.empty(size, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:size]))
    after = np.empty(size, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(begin, end, np.searchsorted(begin, part.bounds))


def hash_words(part: Slice, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    lengths = words.end - words.begin
    padded = np.concatenate([part.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(part.data) + 1,), "<u8", padded, strides=(1,))
    hashes = lengths.astype(np.uint64) * _BASE
    long = np.flatnonzero(lengths > LONG_WORD)
    rest, at = np.flatnonzero(lengths <= LONG_WORD), 0
    while len(rest):
        left = lengths[rest] - at
        chunk = eights[words.begin[rest] + at] & _MASK[np.minimum(left, 8)]
        hashes[rest] = mix((hashes[rest] ^ chunk) * _ODD)
        rest, at = rest[left > 8], at + 8
    for word in long.tolist():
        text = part.data[words.begin[word] : words.end[word]].tobytes()
        hashes[word] = int.from_bytes(blake2b(text, digest_size=8).digest(), "little")
    return hashes


def hash_runs(hashes: np.ndarray, words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of `length` words within a document."""
    count = len(hashes)
    if count < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(words.first[1:], words.counts)[: count - length + 1] - length
    begin = np.flatnonzero(np.arange(count - length + 1) <= last)
    total = np.zeros(len(begin), np.uint64)
    for step, factor in enumerate(_powers(length)):
        total += hashes[begin + step] * factor
    return begin, mix(total)


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive bounds; empty stretches give zero."""
    totals = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return totals[bounds[1:]] - totals[bounds[:-1]]


def code_points(part: Slice) -> np.ndarray:
    """Running number of characters before each byte, and of all at the end."""
    return np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
