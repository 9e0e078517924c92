"""Bounded training samples of hashed features, and the small learners fitted on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.tables import columns
from shelfline.llm.words import Slice, slices, text_column

# Features of a slice's documents: (document, feature id, value), sorted by document.
Features = Callable[[Slice], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Sample:
    """Rows in sparse form; `weight` restores the classes' shares among all labelled rows."""

    bounds: np.ndarray
    index: np.ndarray
    value: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.label)), np.diff(self.bounds))

    def part(self, chosen: np.ndarray) -> Sample:
        keep = np.repeat(chosen, np.diff(self.bounds))
        sizes = np.diff(self.bounds)[chosen]
        return Sample(
            np.concatenate([[0], np.cumsum(sizes)]),
            self.index[keep],
            self.value[keep],
            self.label[chosen],
            self.weight[chosen],
        )

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], len(self.label))


def _featurize(features: Features, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            for part in slices(texts, lower):
                document, index, value = features(part)
                bounds = np.searchsorted(document, np.arange(part.rows + 1))
                own = batch.slice(part.first, part.rows)
                spans = list(zip(bounds[:-1], bounds[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0),
                        own.column(1),
                        pa.array([index[a:b].astype("<u4").tobytes() for a, b in spans]),
                        pa.array([value[a:b].astype("<f4").tobytes() for a, b in spans]),
                    ],
                    ["doc_id", "label", "ids", "vals"],
                )

    return run


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    features: Features,
    rows: int,
    lower: bool = False,
) -> Sample:
    """At most `rows` documents of each class, those with the smallest key hashes.

    Rows without a document, key or label are no samples; several labels of a key count as the
    largest, several texts of a key as the smallest.  Only the hashed features of the sample reach
    the driver: 2 x `rows` rows of at most as many entries as there are feature ids.
    """
    known = (
        columns(labels, ["doc_id", label])
        .dropna()
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("label") == c).orderBy(*order).limit(rows) for c in (0, 1)]
    # At most 2 x `rows` narrow rows, so the broadcast is bounded.
    picked = columns(documents, ["doc_id", "text"]).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id"
    )
    texts = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = (
        texts.select("doc_id", "label", "text")
        .mapInArrow(_featurize(features, lower), f"doc_id {kind}, label int, ids binary, vals binary")
        .toArrow()
        .sort_by("doc_id")
    )
    bounds, index = _joined(found["ids"], "<i4")
    _, value = _joined(found["vals"], "<f4")
    y = np.array(found["label"].to_pylist(), dtype=float)
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([totals.get(int(c), 0) / seen[int(c)] for c in y])
    return Sample(
        bounds,
        index,
        value,
        y,
        weight / weight.mean() if len(weight) else weight,
    )


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, numbers): the numbers of all rows one after the other, without another copy."""
    rows = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    rows = rows.cast(pa.large_binary())
    _, offsets, data = rows.buffers()
    ends = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
    if not len(rows) or data is None:
        return np.zeros(len(rows) + 1, np.int64), np.zeros(0, kind)
    return (ends - ends[0]) // 4, np.frombuffer(data, kind)[ends[0] // 4 : ends[-1] // 4]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Adam:
    """Step sizes per weight; the weights are changed in place."""

    def __init__(self, rate: float):
        self.rate, self.state, self.steps = rate, {}, 0

    def step(self, name: str, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        first, second = self.state.get(name, (0.0, 0.0))
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        self.state[name] = first, second
        size = self.rate / (np.sqrt(second / (1 - 0.99**self.steps)) + 1e-8)
        weights -= size * first / (1 - 0.9**self.steps)
        return size


def fit_logistic(
    sample: Sample, size: int, steps: int, rate: float, l1: float = 0.0, l2: float = 0.0
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by full-batch gradient steps."""
    weights, bias = np.zeros(size), np.zeros(1)
    adam, row = Adam(rate), sample.row
    total = max(sample.weight.sum(), 1e-9)
    for adam.steps in range(1, steps + 1):
        score = np.bincount(row, sample.value * weights[sample.index], len(sample.label)) + bias
        error = sample.weight * (sigmoid(score) - sample.label) / total
        gradient = np.bincount(sample.index, sample.value * error[row], size) + l2 * weights
        size_of_step = adam.step("weights", weights, gradient)
        if l1:
            shrink = np.minimum(size_of_step * l1, rate)
            weights[:] = np.sign(weights) * np.maximum(np.abs(weights) - shrink, 0)
        adam.step("bias", bias, np.array([error.sum()]))
    return weights, float(bias[0])


def fit_calibration(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, shift) so that sigmoid(slope * score + shift) is a probability (Platt scaling).

    Labels are pulled towards one half by the usual counts, so separable rows stay finite; without
    both classes the scores are left as they are.
    """
    good, bad = weight[label == 1].sum(), weight[label == 0].sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    spread = max(float(np.std(score)), 1e-9)
    x = np.stack([score / spread, np.ones_like(score)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - target))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        change = np.linalg.solve(curve, gradient)
        beta -= np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1])
