"""Quality rules: counts of words, symbols and repeats, then a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word and character n-grams, each family as the
share of its own total, fitted on a bounded labelled sample and calibrated on rows held out of it.
Documents are scored in Arrow batches; a fixed probability decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.learning import (
    Sample,
    fit_calibration,
    fit_logistic,
    labelled_sample,
    sigmoid,
)
from shelfline.llm.tables import columns
from shelfline.llm.words import (
    SPACES,
    Slice,
    code_points,
    find_words,
    hash_runs,
    hash_words,
    mix,
    per_document,
    slices,
    text_column,
)

# The base rule.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent

BITS = 16  # feature ids of one family
FAMILIES = 3  # words, word pairs, runs of four bytes
SAMPLE_ROWS = 2000  # labelled rows per class that the classifier is fitted on, at most
REJECT_BELOW = 0.2  # probability of a good document

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def ngrams(part: Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per family the feature ids in document order and each document's bounds among them."""
    words = find_words(part, SPACES)
    hashes = hash_words(part, words)
    pair_at, pairs = hash_runs(hashes, words, 2)
    found = [(hashes, words.first), (pairs, np.searchsorted(pair_at, words.first))]
    data = part.data.astype(np.uint32)
    if len(data) >= 4:
        runs = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    else:
        runs = np.zeros(0, np.uint32)
    # A run that would reach into the next document belongs to none.
    whole = np.ones(len(runs), bool)
    for back in (1, 2, 3):
        over = part.bounds[1:-1] - back
        whole[over[(over >= 0) & (over < len(runs))]] = False
    at = np.flatnonzero(whole)
    found.append((mix(runs[at].astype(np.uint64)), np.searchsorted(at, part.bounds)))
    shift = np.uint64(64 - BITS)
    return [
        ((h >> shift).astype(np.int64) + (i << BITS), bounds)
        for i, (h, bounds) in enumerate(found)
    ]


def ngram_shares(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature id, share) of every n-gram of every document."""
    out = []
    for ids, bounds in ngrams(part):
        sizes = np.diff(bounds)
        document = np.repeat(np.arange(part.rows), sizes)
        code, count = np.unique(document << 20 | ids, return_counts=True)
        of = code >> 20
        out.append((of, code & ((1 << 20) - 1), count / np.maximum(sizes, 1)[of]))
    document, ids, share = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(document, kind="stable")
    return document[order], ids[order], share[order]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, part: Slice) -> np.ndarray:
        """Probability of each document to be good."""
        score = np.full(part.rows, self.bias)
        for ids, bounds in ngrams(part):
            totals = per_document(self.weights[ids], bounds)
            score += totals / np.maximum(np.diff(bounds), 1)
        return sigmoid(self.slope * score + self.shift)


def fit_quality(sample: Sample) -> QualityModel:
    """Fit on four fifths of the sample, calibrate on the rest; with no rows, all are good."""
    size = FAMILIES << BITS
    if not len(sample.label):
        return QualityModel(np.zeros(size, np.float32), 0.0, 1.0, 5.0)
    held = np.arange(len(sample.label)) % 5 == 4
    weights, bias = fit_logistic(sample.part(~held), size, steps=80, rate=0.2, l2=1e-6)
    rest = sample.part(held)
    slope, shift = fit_calibration(rest.dot(weights) + bias, rest.label, rest.weight)
    return QualityModel(weights.astype(np.float32), bias, slope, shift)


def train_quality(
    documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS
) -> QualityModel:
    return fit_quality(labelled_sample(documents, labels, "quality", ngram_shares, sample_rows))


def repeated_lines(part: Slice) -> np.ndarray:
    """Per document, lines with a word that equal an earlier line."""
    out = np.zeros(part.rows, np.int64)
    for i, (a, b) in enumerate(zip(part.bounds[:-1], part.bounds[1:])):
        lines = part.data[a:b].tobytes().split(b"\n")
        if len(lines) > 1:
            lines = [line for line in lines if line.strip()]
            out[i] = len(lines) - len(set(lines))
    return out


def repeated_words(hashes: np.ndarray, words, rows: int) -> np.ndarray:
    """Per document, words inside a window of WINDOW words that the text holds twice or more."""
    begin, runs = hash_runs(hashes, words, WINDOW)
    document = words.document[begin]
    order = np.lexsort((runs, document))
    run, of = runs[order], document[order]
    same = (run[1:] == run[:-1]) & (of[1:] == of[:-1])
    twice = np.zeros(len(run), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(hashes) + 1, np.int64)
    at = begin[order[twice]]
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return per_document(covered.astype(np.int64), words.first)


def base_counts(part: Slice) -> dict[str, np.ndarray]:
    words = find_words(part, SPACES)
    points = code_points(part)
    letters = np.diff(points[part.bounds]) - per_document(
        SPACES[part.data].astype(np.int64), part.bounds
    )
    repeats = repeated_words(hash_words(part, words), words, part.rows)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": letters,
        "n_symbols": per_document(_SYMBOL[part.data].astype(np.int64), part.bounds),
        "n_dup_lines": repeated_lines(part),
        "n_repeat_words": repeats,
        "base_failed": (words.counts < LEAST_WORDS)
        | (100 * repeats > MOST_REPEATED * words.counts),
    }


def judge_quality(
    documents: DataFrame,
    model: QualityModel,
    keep: list[str] = ["doc_id"],  # noqa: B006 - read only
    reject_below: float = REJECT_BELOW,
) -> DataFrame:
    """The `keep` columns, the base counts, base_failed, probability and kept per document.

    A NULL text counts no words, fails the base rule and is not kept.  Repeated rows are all
    judged; an empty table stays empty.  `keep` may hold any columns but the added ones.
    """

    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(text_column(batch)):
                own = batch.select(keep).slice(part.first, part.rows)
                counts = base_counts(part)
                counts["probability"] = model.probability(part)
                counts["kept"] = ~counts["base_failed"] & (
                    counts["probability"] >= reject_below
                )
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *(pa.array(x) for x in counts.values())], [*keep, *counts]
                )

    rows = columns(documents, dict.fromkeys(["text", *keep]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(
        judge,
        f"{kinds}, {' bigint, '.join(added)} bigint, base_failed boolean, probability double, "
        "kept boolean",
    )


def filter_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """The documents that are kept, with their own columns."""
    names = documents.columns
    judged = judge_quality(documents, model, names).where("kept")
    return judged.select(*(F.col(f"`{c}`") for c in names))
