"""Secret scan: fixed patterns, and random-looking strings found by two Markov models.

One first-order character model is trained on random strings, one on ordinary words; a token is
reported when the log-likelihood ratio favours the first.  Labelled samples come from the corpus:
what the fixed patterns match is random, every other word that is too short to be judged is
ordinary.  All documents count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.tables import columns
from shelfline.llm.words import Slice, find_words, slices, text_column

# The base patterns, in the order of their kinds.
KINDS = ["assign", "access", "hex", "model"]
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_HINTS = [b"passw", b"secret", b"token", b"api"]
LEAST_VALUE = 12
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ACCESS = 18
LEAST_HEX = 16

LEAST_TOKEN = 16  # characters of a string that the models judge
LEAST_RATIO = 0.7  # log-likelihood ratio per character, in nats
MASK = b"[secret]"

_HEX = np.ones(256, bool)
_HEX[list(b"0123456789abcdef")] = False
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LETTERS = len(_ALPHABET)
START = LETTERS
_CLASS = np.full(256, -1, np.int64)
_CLASS[list(_ALPHABET)] = np.arange(LETTERS)
_OUTSIDE = _CLASS < 0

Span = tuple[int, int, int]  # begin, kind, end


def _long_runs(part: Slice, outside: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document, begin, end) of the runs of `least` bytes or more."""
    runs = find_words(part, outside)
    long = np.flatnonzero(runs.end - runs.begin >= least)
    return runs.document[long], runs.begin[long], runs.end[long]


def base_spans(part: Slice) -> list[list[Span]]:
    """Per document the spans of the fixed patterns, in bytes of the slice.

    Runs of hexadecimal digits and access keys of the least length are the same as longer-or-
    dropped matches; an assignment that is too short still uses up its text.
    """
    found: list[list[Span]] = [[] for _ in range(part.rows)]
    for document, begin, end in zip(*_long_runs(part, _HEX, LEAST_HEX)):
        found[document].append((int(begin), 2, int(end)))
    whole = part.data.tobytes()
    small = whole.lower()
    for i, (a, b) in enumerate(zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist())):
        if any(small.find(hint, a, b) >= 0 for hint in ASSIGN_HINTS):
            found[i] += [
                (m.start(), 0, m.end())
                for m in ASSIGN.finditer(whole, a, b)
                if m.end(2) - m.start(2) >= LEAST_VALUE
            ]
        if whole.find(b"AKIA", a, b) >= 0:
            found[i] += [
                (m.start(), 1, m.end())
                for m in ACCESS.finditer(whole, a, b)
                if m.end() - m.start() >= LEAST_ACCESS
            ]
        found[i].sort()
    return found


def _pair_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of (previous, next) letters of the strings, each led in by START."""
    lengths = end - begin
    starts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(starts, lengths) + np.repeat(begin, lengths)
    after = _CLASS[data[at]]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[starts] = START
    return before * LETTERS + after


def count_pairs(documents: DataFrame) -> DataFrame:
    """(random, pair, count) over all documents: 2 x 67 x 66 rows at most."""
    cells = (LETTERS + 1) * LETTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, cells), np.int64)
        for batch in batches:
            for part in slices(text_column(batch)):
                spans = [(a, b) for row in base_spans(part) for a, _, b in row]
                edges = np.zeros(len(part.data) + 1, np.int64)
                for a, b in spans:
                    edges[a] += 1
                    edges[b] -= 1
                matched = np.cumsum(edges[:-1]) > 0
                tokens = find_words(part, _OUTSIDE)
                random = matched[tokens.begin] if len(tokens.begin) else np.zeros(0, bool)
                size = tokens.end - tokens.begin
                # Strings that the models will judge are no samples of ordinary words, and a
                # pattern's keyword is too short to count as random.
                kinds = ((0, ~random & (size < LEAST_TOKEN)), (1, random & (size >= LEAST_VALUE)))
                for label, chosen in kinds:
                    begin, end = tokens.begin[chosen], tokens.end[chosen]
                    if len(begin):
                        codes = _pair_codes(part.data, begin, end)
                        totals[label] += np.bincount(codes, minlength=cells)
        label, pair = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(label.astype(np.int32)),
                pa.array(pair.astype(np.int32)),
                pa.array(totals[label, pair]),
            ],
            ["random", "pair", "count"],
        )

    return (
        columns(documents, ["text"])
        .mapInArrow(count, "random int, pair int, count bigint")
        .groupBy("random", "pair")
        .agg(F.sum("count").alias("count"))
    )


@dataclass
class RandomnessModel:
    ratio: np.ndarray  # log-likelihood ratio of (previous, next)

    def judge(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mean log-likelihood ratio of each string."""
        if not len(begin):
            return np.zeros(0)
        lengths = end - begin
        terms = self.ratio[_pair_codes(data, begin, end)]
        return np.add.reduceat(terms, np.cumsum(lengths) - lengths) / lengths


def fit_randomness(counts: list[tuple[int, int, int]]) -> RandomnessModel:
    """Both models from (random, pair, count).  Each is mixed with even odds for every letter:
    half of the random model, for strings of other alphabets than the samples', and a hundredth
    of the ordinary one.  Without samples a model is even."""
    table = np.full((2, LETTERS + 1, LETTERS), 1e-3)
    for random, pair, count in counts:
        table[random, pair // LETTERS, pair % LETTERS] += count
    odds = table / table.sum(axis=2, keepdims=True)
    even = np.array([0.01, 0.5])[:, None, None]
    odds = (1 - even) * odds + even / LETTERS
    return RandomnessModel((np.log(odds[1]) - np.log(odds[0])).ravel())


def train_randomness(documents: DataFrame) -> RandomnessModel:
    """Only the bounded table of pair counts reaches the driver."""
    return fit_randomness([tuple(row) for row in count_pairs(documents).collect()])


def find_spans(part: Slice, model: RandomnessModel, least: float) -> list[list[Span]]:
    """Per document the base spans and, apart from those, the model's; in bytes, by begin."""
    found = base_spans(part)
    document, begin, end = _long_runs(part, _OUTSIDE, LEAST_TOKEN)
    random = np.flatnonzero(model.judge(part.data, begin, end) >= least)
    for at in random.tolist():
        a, b, own = int(begin[at]), int(end[at]), found[document[at]]
        if all(b <= x or y <= a for x, _, y in own):
            own.append((a, 3, b))
    for own in found:
        own.sort()
    return found


def _places(part: Slice, row: int, spans: list[Span]) -> list[tuple[int, int, int]]:
    """Spans in characters of the text."""
    text = part.data[part.bounds[row] : part.bounds[row + 1]]
    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    base = part.bounds[row]
    return [(int(points[a - base]), kind, int(points[b - base])) for a, kind, b in spans]


def _names(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan_secrets(
    documents: DataFrame, model: RandomnessModel, least: float = LEAST_RATIO
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256 and spans of every row.

    A span is the whole match, `kind:start:end` in characters.  A NULL or empty text has none:
    empty spans and the digest of the empty text.  Repeated rows are all scanned, an empty table
    stays empty, other columns are dropped.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(text_column(batch)):
                counts = np.zeros((len(KINDS), part.rows), np.int64)
                digests, names = [], []
                for row, spans in enumerate(find_spans(part, model, least)):
                    for _, kind, _ in spans:
                        counts[kind, row] += 1
                    placed = _places(part, row, spans) if spans else []
                    base = _names([s for s in placed if s[1] < 3])
                    digests.append(hashlib.sha256(base.encode()).hexdigest())
                    names.append(_names(placed))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.rows),
                        *(pa.array(c) for c in counts),
                        pa.array(digests),
                        pa.array(names),
                    ],
                    ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"],
                )

    rows = columns(documents, ["doc_id", "text"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        scan,
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_model bigint, "
        "base_sha256 string, spans string",
    )


def _masked(text: bytes, spans: list[Span]) -> bytes:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return b"".join([*out, text[at:]])


def mask_secrets(
    documents: DataFrame, model: RandomnessModel, least: float = LEAST_RATIO
) -> DataFrame:
    """The documents with every span replaced by a mask; all rows and columns are kept.

    Overlapping spans become one mask, a NULL text stays NULL, and `n_chars`, where present,
    is counted anew for changed texts."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            changed = [False] * len(texts)
            for part in slices(text_column(batch)):
                for row, spans in enumerate(find_spans(part, model, least)):
                    if spans:
                        a, b = part.bounds[row : row + 2]
                        own = [(x - a, kind, y - a) for x, kind, y in spans]
                        text = _masked(part.data[a:b].tobytes(), own)
                        texts[part.first + row] = text.decode()
                        changed[part.first + row] = True
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(texts, pa.string()) if n == "text" else c
                      for n, c in zip(batch.schema.names, batch.columns)),
                    pa.array(changed),
                ],
                [*batch.schema.names, "_changed"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    done = documents.mapInArrow(mask, f"{kinds}, _changed boolean")
    if "n_chars" in documents.columns:
        counted = F.when(F.col("_changed"), F.length("text")).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", counted.cast(documents.schema["n_chars"].dataType))
    return done.drop("_changed")
