from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from shelfline.llm import toxicity as tox
from shelfline.llm.learning import Sample
from tests.llm.cases import empty, frame, odd_texts, prose, tuples

INSULTS = ["Grobian", "grobianer", "flegel", "FLEGELEI", "rüpel"]


def corpus(rows=500):
    out = []
    for n in range(rows):
        words, toxic = prose(3000 + n, 40).split(), n % 4 == 0
        if toxic:
            pick = random.Random(n)
            for _ in range(2):
                words.insert(pick.randrange(40), pick.choice(INSULTS))
        out.append((n + 100, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus()
    labels = spark.createDataFrame(
        [(i, y) for i, _, y in rows] + [(None, 1), (100, None)], "doc_id bigint, toxic int"
    )
    return tox.train_toxicity(frame(spark, [(i, t) for i, t, _ in rows]), labels)


def test_held_out_rows_are_told_apart(spark, model):
    rows = corpus()
    got = {r.doc_id: r for r in tox.score_toxicity(frame(spark, [(i, t) for i, t, _ in rows]), model).collect()}
    for doc_id, _, _ in rows:
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert got[doc_id].predicted == int(got[doc_id].score >= 0.7)
    held = [(got[i].score, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95


def test_held_out_labels_do_not_matter(spark, model):
    rows = corpus()
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    labels = spark.createDataFrame(flipped, "doc_id bigint, toxic int")
    again = tox.train_toxicity(frame(spark, [(i, t) for i, t, _ in rows]), labels)
    assert again.bias == model.bias and (again.factors == model.factors).all()


def test_odd_rows(spark, model):
    rows = odd_texts()
    got = tox.score_toxicity(frame(spark, rows), model)
    assert [r[0] for r in tuples(got, "doc_id")] == [r[0] for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    scores = {r.doc_id: r.score for r in got.collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2] == scores[3]
    assert tox.score_toxicity(empty(spark), model).count() == 0


def test_text_keys(spark):
    rows = corpus(300)
    docs = frame(spark, [(i, t) for i, t, _ in rows]).selectExpr("concat('k', doc_id) AS doc_id", "text")
    labels = spark.createDataFrame([(f"k{i}", y) for i, _, y in rows], "doc_id string, toxic int")
    scored = tox.score_toxicity(docs, tox.train_toxicity(docs, labels)).collect()
    toxic = {f"k{i}": y for i, _, y in rows}
    assert np.mean([(r.score >= 0.7) == toxic[r.doc_id] for r in scored]) > 0.9


def test_without_labels_every_score_is_low(spark):
    docs = frame(spark, odd_texts())
    none = tox.train_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.predicted for r in tox.score_toxicity(docs, none).collect()} == {0}


def neutral_pairs(rows=3000):
    """Toxic if both of two words are there or none: neither tells anything alone."""
    out = []
    for n in range(rows):
        pick, words = random.Random(n), prose(9000 + n, 25).split()
        a, b = pick.random() < 0.5, pick.random() < 0.5
        for there, word in ((a, "zebra"), (b, "quillon")):
            if there:
                words.insert(pick.randrange(25), word)
        out.append((n, " ".join(words), int(a == b)))
    return out


def test_a_pair_of_neutral_terms_is_learnt(spark):
    rows = neutral_pairs()
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    scored = tox.score_toxicity(docs, tox.train_toxicity(docs, labels)).collect()
    label = {i: y for i, _, y in rows}
    held = [(r.score >= 0.5) == bool(label[r.doc_id]) for r in scored if r.held_out]
    assert len(held) > 900 and np.mean(held) > 0.9


def test_pair_directions_are_those_of_the_whole_matrix():
    random_ = np.random.default_rng(4)
    held = random_.random((200, 12)) < 0.4
    error = np.where(held[:, 3] == held[:, 7], 1.0, -1.0) + random_.normal(0, 0.1, 200)
    bounds = np.concatenate([[0], held.sum(axis=1).cumsum()])
    index = np.nonzero(held)[1]
    sample = Sample(bounds, index, np.ones(len(index)), error > 0, np.ones(200))
    found, got = tox.pair_directions(sample, error, 12, rounds=60)
    whole = (held * error[:, None]).T.astype(float) @ held
    np.fill_diagonal(whole, 0)
    scale = 1 / np.sqrt(held.sum(axis=0))
    values, vectors = np.linalg.eigh(whole * scale[:, None] * scale)
    assert found[0] == pytest.approx(values[-1])
    assert np.allclose(np.abs(got[:, 0]), np.abs(vectors[:, -1]), atol=1e-3)
    loaded = tox.pair_loadings(sample, error, 12)
    assert set(np.argsort(-np.abs(loaded[:, 0]))[:2]) == {3, 7}
    assert np.abs(loaded).max() == 1.0


def test_machine_and_gradients():
    """The fast sums equal the pairwise definition, and pairs that add up to nothing are learnt."""
    weights, factors = np.array([0.5, -1.0, 2.0]), np.array([[1.0, 2], [0.5, -1], [3, 0.1]])
    index, row = np.array([0, 1, 2, 1]), np.array([0, 0, 0, 1])
    pairs = sum(factors[i] @ factors[j] for i, j in ((0, 1), (0, 2), (1, 2)))
    assert np.allclose(tox.machine(index, row, 3, weights, factors), [weights.sum() + pairs, -1.0, 0])
    # Toxic only when exactly both terms meet: additive weights cannot tell it.
    rows = [[0], [1], [0, 1], []] * 50
    label = np.array([0.0, 0, 1, 0] * 50)
    sample = Sample(
        np.cumsum([0, *map(len, rows)]), np.array([i for r in rows for i in r]),
        np.ones(200), label, np.ones(200),
    )
    small = np.random.Generator(np.random.PCG64(11)).normal(0, 0.05, (2, tox.FACTORS))
    w, v, b = tox.fit_factors(sample, np.zeros(2), 0.0, small, steps=400, rate=0.05, l2=0.0)
    scores = b + tox.machine(sample.index, sample.row, 200, w, v)
    assert (scores[label == 1].min() > 0) and (scores[label == 0].max() < 0)
