"""Nearest neighbours against brute force: exact measures and order, recall, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from shelfline.llm.vector_search import nearest_neighbours, scan

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def frame(spark, vectors):
    return spark.createDataFrame(
        [(i, [float(x) for x in v] if v is not None else None, 0) for i, v in vectors], SCHEMA
    ).selectExpr("*", "1 AS query", "2 AS score", "3 AS row")


def plain(vectors, query, kept=10):
    """The nearest (vec_id, distance) of a query's row in (vec_id, vector) rows."""
    ids = np.array([i if i is not None else np.inf for i, _ in vectors], float)
    rows = np.array([np.asarray(v, np.float32) for _, v in vectors], float)
    apart = rows - rows[query]
    distances = np.sqrt((apart * apart).sum(axis=1))
    order = [n for n in np.lexsort((ids, distances)) if n != query][:kept]
    return [(vectors[n][0], distances[n]) for n in order]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def hits(got, vectors, every=100):
    right = total = 0
    for query, (i, _) in enumerate(vectors):
        if i is not None and i % every == 0:
            best = plain(vectors, query)
            assert [s for _, s in got[i]] == sorted(s for _, s in got[i])
            right += len({n for n, _ in best} & {n for n, _ in got[i]})
            total += len(best)
    return right / total


@pytest.mark.parametrize("clusters", [0, 30])
def test_recall_and_exact_distances(spark, clusters):
    random = np.random.default_rng(clusters)
    rows = random.normal(size=(4000, 40))
    if clusters:
        rows = random.normal(size=(clusters, 40))[random.integers(clusters, size=4000)] + 0.2 * rows
    vectors = [(n, v) for n, v in enumerate(rows)]
    got = found(nearest_neighbours(frame(spark, vectors), part_rows=300))
    assert sorted(got) == list(range(0, 4000, 100))
    assert hits(got, vectors) >= 0.9
    whole = np.asarray(rows, np.float32).astype(float)
    for query, near in got.items():
        assert query not in {i for i, _ in near} and len(near) == 10
        for i, score in near:
            assert score == pytest.approx(np.linalg.norm(whole[i] - whole[query]), rel=1e-12)


def test_copies_are_tied_by_number(spark):
    random = np.random.default_rng(1)
    vectors = [(n, np.ones(8) if n % 3 == 0 else random.normal(size=8)) for n in range(900)]
    got = found(nearest_neighbours(frame(spark, vectors), part_rows=100))
    assert got[300] == [(3 * n, 0.0) for n in range(10)]
    assert got[0] == [(3 * n, 0.0) for n in range(1, 11)]


def test_odd_rows(spark):
    random = np.random.default_rng(2)
    sound = [(n, random.normal(size=6)) for n in range(1, 40)]
    sound += [(100, sound[0][1]), (100, sound[1][1]), (None, sound[2][1]), (200, random.normal(size=6))]
    odd = [
        (300, None),
        (400, []),
        (500, np.zeros(6)),
        (600, [1, 2, 3, np.nan, 5, 6]),
        (700, [1, 2, 3, np.inf, 5, 6]),
        (800, [1, 2, 3]),
    ]
    df = frame(spark, sound + odd).union(
        spark.sql("SELECT 900, array(1.0F, NULL, 1.0F, 1.0F, 1.0F, 1.0F), 0, 1, 2, 3")
    )
    rows = nearest_neighbours(df).collect()
    assert {r["query_id"] for r in rows} == {100, 200}
    assert len(rows) == 30  # both rows with number 100 are queries
    near = [(r["vec_id"], r["score"]) for r in rows if r["query_id"] == 200]
    assert near == [(i, pytest.approx(s)) for i, s in plain(sound, len(sound) - 1)]


def test_few_rows_give_all_candidates(spark):
    vectors = [(n, [n, 1.0]) for n in range(98, 104)]
    got = found(nearest_neighbours(frame(spark, vectors)))
    assert [i for i, _ in got[100]] == [99, 101, 98, 102, 103]
    assert nearest_neighbours(frame(spark, [(100, [1.0, 2.0])])).collect() == []
    assert nearest_neighbours(frame(spark, [])).collect() == []


def test_a_scan_abandons_only_what_is_far():
    random = np.random.default_rng(3)
    vectors = random.normal(size=(2000, 64))
    blocks = [np.ascontiguousarray(vectors[:, at : at + 16]) for at in range(0, 64, 16)]
    names = np.arange(2000)
    right = 0
    for query in vectors[:50]:
        at, _ = scan(query, query, blocks, vectors, names < 0, float("inf"), names, 10)
        right += len(set(at) & set(np.argsort(((vectors - query) ** 2).sum(1))[:10]))
    assert right >= 0.98 * 500
