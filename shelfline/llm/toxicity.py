"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words and their first 4, 5 and 6 bytes.  Single terms have additive
weights; pairs of terms interact through the product of their factors, so that an insult beside
a group's mention can weigh more than the two apart.  Additive weights are chosen by a lasso.
Factors are chosen apart from them, by what they would add to: the pair sums of the additive part's
errors, over all terms of the sample, so that two terms that mean nothing alone can meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.learning import (
    Adam,
    Sample,
    fit_calibration,
    fit_logistic,
    labelled_sample,
    sigmoid,
)
from shelfline.llm.tables import columns
from shelfline.llm.words import (
    MARKS,
    Slice,
    Words,
    find_words,
    hash_words,
    slices,
    text_column,
)

BITS = 18
PREFIXES = (4, 5, 6)
FACTORS = 4
SAMPLE_ROWS = 3000  # labelled rows per class that the model is fitted on, at most
TOXIC_FROM = 0.7
LASSO = 6e-4
LEAST_ROWS = 3  # sample rows a term must occur in
START = 0.5  # largest factor before the fit
SHRINK = 4e-3  # of a term's factors, per step
PAIRED_TERMS = 1000  # beside the lasso's that get factors, those that the pair sums load most

_SHIFT = np.uint64(64 - BITS)


def term_ids(part: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature id) of the words, then of each kind of prefix; terms repeat."""
    words = find_words(part, MARKS)
    document = words.document
    yield document, (hash_words(part, words) >> _SHIFT).astype(np.int64)
    for length in PREFIXES:
        longer = np.flatnonzero(words.end - words.begin >= length)
        begin = words.begin[longer]
        heads = hash_words(part, Words(begin, begin + length, words.first))
        # A prefix is another term than the word that is spelt like it.
        yield document[longer], (heads * np.uint64(2 * length + 1) >> _SHIFT).astype(np.int64)


def distinct_terms(part: Slice, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature id) of the distinct terms, in order; only `active` ones if given."""
    found = []
    for document, ids in term_ids(part):
        if active is not None:
            known = active[ids]
            document, ids = document[known], ids[known]
        found.append(document << BITS | ids)
    codes = np.unique(np.concatenate(found))
    return codes >> BITS, codes & ((1 << BITS) - 1)


def term_features(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    document, ids = distinct_terms(part)
    return document, ids, np.ones(len(ids))


@dataclass
class ToxicityModel:
    bias: float
    slope: float
    shift: float
    row: np.ndarray  # of each feature id among the active ones, or -1
    weights: np.ndarray
    factors: np.ndarray

    def score(self, part: Slice) -> np.ndarray:
        """Probability of each document to be toxic; an empty text has the bias alone."""
        document, ids = distinct_terms(part, self.row >= 0)
        raw = self.bias + machine(self.row[ids], document, part.rows, self.weights, self.factors)
        return sigmoid(self.slope * tame(raw) + self.shift)


def tame(raw: np.ndarray) -> np.ndarray:
    """Interactions grow with the square of the terms; their logarithm calibrates evenly."""
    return np.sign(raw) * np.log1p(np.abs(raw))


def machine(
    index: np.ndarray, row: np.ndarray, rows: int, weights: np.ndarray, factors: np.ndarray
) -> np.ndarray:
    """Additive part and interactions of rows with the given active terms."""
    out = np.bincount(row, weights[index], rows).astype(float)
    for v in factors.T:
        total = np.bincount(row, v[index], rows)
        out += 0.5 * (total**2 - np.bincount(row, v[index] ** 2, rows))
    return out


def pair_directions(
    sample: Sample, error: np.ndarray, size: int, rounds: int = 15
) -> tuple[np.ndarray, np.ndarray]:
    """(values, one column per value) of the leading directions of the pair sums.

    A pair's sum is the error of the rows that hold both terms, over the root of the terms' numbers
    of rows.  The matrix of all pairs is never made: a product with it is two passes over the
    sample's entries.
    """
    row, index, rows = sample.row, sample.index, len(sample.label)
    many = np.bincount(index, minlength=size)
    scale = 1 / np.sqrt(np.maximum(many, 1))
    own = np.bincount(index, error[row], size)

    def product(v: np.ndarray) -> np.ndarray:
        v = v * scale
        both = np.bincount(index, (error * np.bincount(row, v[index], rows))[row], size)
        return scale * (both - own * v)

    start = np.random.Generator(np.random.PCG64(7)).normal(size=(size, 2 * FACTORS))
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(np.stack([product(v) for v in basis.T], axis=1))[0]
    inner = basis.T @ np.stack([product(v) for v in basis.T], axis=1)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-values)[:FACTORS]
    return values[best], basis @ vectors[:, best]


def pair_loadings(sample: Sample, error: np.ndarray, size: int, rounds: int = 15) -> np.ndarray:
    """How much each term takes part in the leading directions, one column each, 1 at most.

    Only positive directions count: products of factors have no others."""
    if size < 2 * FACTORS:
        return np.zeros((size, FACTORS))
    values, vectors = pair_directions(sample, error, size, rounds)
    loaded = vectors * np.maximum(values, 0)
    return loaded / max(np.abs(loaded).max(), 1e-12)


def fit_factors(
    sample: Sample,
    weights: np.ndarray,
    bias: float,
    factors: np.ndarray,
    steps: int,
    rate: float,
    l2: float,
    l1: float = 0.0,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Refine the additive weights and the factors; `l1` shrinks a term's factors together, and a
    term that is shrunk to nothing has none."""
    size, rows = len(weights), len(sample.label)
    weights, factors, offset = weights.copy(), factors.copy(), np.array([bias])
    adam, row, index = Adam(rate), sample.row, sample.index
    total = max(sample.weight.sum(), 1e-9)
    for adam.steps in range(1, steps + 1):
        score = offset + machine(index, row, rows, weights, factors)
        error = sample.weight * (sigmoid(score) - sample.label) / total
        spread = error[row]
        pull = np.empty_like(factors)
        for k, v in enumerate(factors.T):
            others = np.bincount(row, v[index], rows)[row] - v[index]
            pull[:, k] = np.bincount(index, spread * others, size)
        adam.step("weights", weights, np.bincount(index, spread, size) + l2 * weights)
        adam.step("factors", factors, pull + l2 * factors)
        if l1:
            length = np.sqrt((factors**2).sum(axis=1, keepdims=True))
            factors *= np.maximum(1 - l1 / np.maximum(length, 1e-12), 0)
        adam.step("bias", offset, np.array([error.sum()]))
    return weights, factors, float(offset[0])


def fit_toxicity(sample: Sample) -> ToxicityModel:
    """Lasso for the terms that matter alone, pair sums for those that matter together, factors on
    both, calibration on a fifth held out.

    Without rows of both classes the score is the share of toxic rows."""
    row = np.full(1 << BITS, -1, np.int64)
    toxic = float((sample.weight * sample.label).sum() / max(sample.weight.sum(), 1e-9))
    if not 0 < toxic < 1:
        prior = min(max(toxic, 0.01), 0.99)
        return ToxicityModel(
            0.0, 1.0, np.log(prior / (1 - prior)), row, np.zeros(0), np.zeros((0, FACTORS))
        )
    held = np.arange(len(sample.label)) % 5 == 4
    rest = sample.part(~held)
    # Number the frequent terms anew, so that the learners work on short arrays.
    frequent = np.flatnonzero(np.bincount(rest.index, minlength=1 << BITS) >= LEAST_ROWS)
    rest = only(rest, frequent)
    weights, bias = fit_logistic(rest, len(frequent), steps=120, rate=0.1, l1=LASSO)
    score = np.bincount(rest.row, weights[rest.index], len(rest.label)) + bias
    error = rest.weight * (rest.label - sigmoid(score))
    loadings = pair_loadings(rest, error, len(frequent))
    strength = np.abs(loadings).max(axis=1, initial=0)
    paired = np.argsort(-strength, kind="stable")[:PAIRED_TERMS]
    alone = np.flatnonzero(weights)
    best = None
    # Chance alone loads many terms; the rows held out decide whether the pairs stay.
    for kept in (alone, np.union1d(alone, paired[strength[paired] > 0])):
        # The lasso's terms start with small factors of their own beside the loadings.
        start = np.random.Generator(np.random.PCG64(11)).normal(0, 0.05, (len(kept), FACTORS))
        start *= (weights[kept] != 0)[:, None]
        if len(kept) > len(alone):
            start += START * loadings[kept]
        found, factors, offset = fit_factors(
            only(rest, kept), weights[kept], bias, start, steps=80, rate=0.02, l2=3e-4, l1=SHRINK
        )
        live = (found != 0) | (factors != 0).any(axis=1)
        model = _calibrated(sample, held, frequent[kept[live]], found[live], factors[live], offset)
        if best is None or model[0] < best[0]:
            best = model
    return best[1]


def _calibrated(
    sample: Sample, held: np.ndarray, ids: np.ndarray, weights, factors, bias: float
) -> tuple[float, ToxicityModel]:
    """(log loss, model), both from the rows held out."""
    row = np.full(1 << BITS, -1, np.int64)
    row[ids] = np.arange(len(ids))
    known = row[sample.index] >= 0
    raw = bias + machine(
        row[sample.index[known]], sample.row[known], len(sample.label), weights, factors
    )
    label, weight = sample.label[held], sample.weight[held]
    slope, shift = fit_calibration(tame(raw[held]), label, weight)
    model = ToxicityModel(bias, max(slope, 1e-3), shift, row, weights, factors)
    chance = sigmoid(model.slope * tame(raw[held]) + shift)
    loss = -np.log(np.maximum(np.where(label == 1, chance, 1 - chance), 1e-12))
    return float((weight * loss).sum()), model


def only(sample: Sample, ids: np.ndarray) -> Sample:
    """The sample's entries among the sorted `ids`, numbered by their place there."""
    if not len(ids):
        none = np.zeros(0, np.int64)
        return Sample(np.zeros_like(sample.bounds), none, none * 1.0, sample.label, sample.weight)
    place = np.minimum(np.searchsorted(ids, sample.index), len(ids) - 1)
    kept = ids[place] == sample.index
    bounds = np.concatenate([[0], np.cumsum(kept)])[sample.bounds]
    return Sample(bounds, place[kept], sample.value[kept], sample.label, sample.weight)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 3 == 1


def train_toxicity(
    documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS
) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    seen = columns(labels, ["doc_id", "toxic"]).where(~held_out(F.col("doc_id")))
    return fit_toxicity(
        labelled_sample(documents, seen, "toxic", term_features, sample_rows, lower=True)
    )


def score_toxicity(
    documents: DataFrame, model: ToxicityModel, toxic_from: float = TOXIC_FROM
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; a NULL text is an empty one.

    Repeated rows are all scored, an empty table stays empty, other columns are dropped.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(text_column(batch), lower=True):
                found = model.score(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(part.first, part.rows).columns[:2],
                        pa.array(found),
                        pa.array((found >= toxic_from).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = columns(documents, ["doc_id", "text"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
