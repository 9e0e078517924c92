from __future__ import annotations

import random

import pytest

from shelfline.llm import jaccard_join as jj
from shelfline.llm.components import connected_components
from tests.llm.cases import ASCII_LOWER, SPACED, empty, frame, odd_texts, ordered, prose, tuples


def shingles(text, k):
    w = SPACED.findall((text or "").translate(ASCII_LOWER))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return ordered((d, len(s), smallest.get(root(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def edited(text, seed, edits):
    pick, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[pick.randrange(len(w))] = f"z{pick.randrange(10**6)}"
    return " ".join(w)


def near_copies(seed, count, words):
    base = prose(seed, words)
    return [edited(base, seed * 1000 + n, n % 9) for n in range(count)]


def corpus(seed=0):
    texts = near_copies(1, 60, 120) + near_copies(2, 30, 300) + near_copies(3, 12, 25)
    line = prose(77, 15)
    texts += [line + "\n" + prose(n, 40) + "\n" + line for n in range(300, 330)]
    texts += [" ".join([line, *[f"q{n}"] * 2]) for n in range(12)]  # short, mostly the common line
    texts += [prose(9, 40)] * 15 + [prose(9, 40).upper()] * 3 + ["a b", "A  b", "a b c", "one", "ONE", ""]
    chain = prose(8, 200).split()
    texts += [" ".join(chain[n * 4 : n * 4 + 120]) for n in range(20)]
    random.Random(seed).shuffle(texts)
    return [(1000 - n, t) for n, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = corpus() + [r for r in odd_texts() if r[0] not in (5, None)]
    got = jj.near_duplicates(frame(spark, rows, clash=False))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == plain(rows)
    assert got.groupBy("component_id").count().where("count > 10").count() >= 3


@pytest.mark.parametrize("k,percent", [(1, 60), (3, 95), (2, 100)])
def test_other_lengths_and_limits(spark, k, percent):
    rows = corpus(1)[::2]
    got = jj.near_duplicates(frame(spark, rows), k, percent)
    assert tuples(got, "doc_id", "n_shingles", "component_id") == plain(rows, k, percent)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_NGRAMS", 100)
    rows = corpus(2)
    got = jj.near_duplicates(frame(spark, rows).repartition(7))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == plain(rows)


def test_odd_rows_and_empty(spark):
    rows = odd_texts()
    got = jj.near_duplicates(frame(spark, rows))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == plain(rows)
    assert jj.near_duplicates(empty(spark)).count() == 0


def stays(rows):
    """Rows by component, from the plain version on numbers that do not repeat."""
    place = {n: i for n, i in enumerate(sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)))}
    numbered = [(n, rows[i][1]) for n, i in place.items()]
    return ordered((rows[place[d]][0], ) for d, _, c in plain(numbered) if d == c)


def test_one_of_each_stays(spark):
    rows = corpus(3) + [r for r in odd_texts() if r[0] is not None]
    docs = frame(spark, rows)
    kept = jj.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert tuples(kept, "doc_id") == stays(rows)


def test_repeated_keys_lose_no_text_and_keep_no_copy(spark):
    a, b, c = prose(50, 80), prose(51, 80), prose(52, 80)
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (8, c), (None, a), (None, c + " x"), (9, None), (9, None), (9, "")]
    rows += [(None, prose(60)), (None, prose(60))]
    kept = jj.keep_one_each(frame(spark, rows))
    expected = [(3, b), (5, a), (7, c), (9, None), (9, None), (9, ""), (None, prose(60))]
    expected.append((None, c + " x"))  # a set that only rows without a key have is compared with none
    assert tuples(kept, "doc_id", "text") == ordered(expected)


def test_components_of_a_long_chain(spark):
    order = list(range(40))
    random.Random(4).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(29)] + [(100, 101), (101, 102), (7, 7)]
    found = connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    smallest = min(order[:30])
    expected = [(n, smallest) for n in order[:30]] + [(n, 100) for n in (100, 101, 102)]
    assert tuples(found, "node", "root") == sorted(expected)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
