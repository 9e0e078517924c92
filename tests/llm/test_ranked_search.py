"""Ranked search against a plain version that scores every document."""

from __future__ import annotations

import math
import random
from collections import Counter

from shelfline.llm.ranked_search import search
from tests.llm.cases import ALNUM, ASCII_LOWER, empty, frame, odd_texts, prose

ITEMS = "item_id bigint, text string"


def terms(text):
    return ALNUM.findall((text or "").translate(ASCII_LOWER))


def plain(documents, items, kept=10):
    texts = [(doc_id, Counter(terms(text))) for doc_id, text in documents]
    sizes = [sum(found.values()) for _, found in texts]
    n, length = sum(s > 0 for s in sizes), sum(sizes) or 1
    df = Counter(t for _, found in texts for t in found)
    out = []
    for item_id, text in set(items):
        scored = []
        for (doc_id, found), size in zip(texts, sizes):
            m = 25 + 75 * size * n // length
            score = sum(
                repeats
                * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * (1000000000 * found[t] // (1000 * found[t] + 8 * m))
                for t, repeats in Counter(terms(text)).items()
                if t in found
            )
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:kept], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_odd_rows_equal_plain_version(spark):
    documents = odd_texts() + [(20 + n, prose(n, 5 + 7 * n, 80)) for n in range(40)]
    documents += [(100 + n, prose(3) + " shared tail") for n in range(30)]  # copies, ties
    items = [
        (1, prose(1)),
        (2, prose(3) + " " + prose(3, 20)),
        (3, None),
        (4, ""),
        (5, "nowhere to be found qqq"),
        (6, "Éa 日本 ONE two"),
        (7, prose(500, 200, 80)),
        (7, prose(501, 9, 80)),
        (8, prose(9, 3, 80)),
        (8, prose(9, 3, 80)),
    ]
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS score", "2 AS rank", "3 AS row")
    for first_terms in (1, 4):
        result = search(frame(spark, documents).repartition(3), asked, first_terms=first_terms)
        assert found(result) == plain(documents, items)


def test_early_stop_keeps_whole_results(spark):
    pick = random.Random(5)
    vocabulary = [f"w{n}" for n in range(400)]
    weights = [1 / (n + 1) for n in range(400)]
    documents = [
        (n, " ".join(pick.choices(vocabulary, weights, k=pick.randrange(5, 120)))) for n in range(600)
    ]
    items = [(n, " ".join(pick.choices(vocabulary, weights, k=40))) for n in range(12)]
    # Passages that many documents hold, so that accumulators are limited early.
    documents += [(1000 + n, items[n % 3][1] + f" tail{n}") for n in range(60)]
    asked = spark.createDataFrame(items, ITEMS)
    for kept in (1, 10):
        result = search(frame(spark, documents, False), asked, kept=kept, first_terms=2)
        assert found(result) == plain(documents, items, kept)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "one two")], ITEMS)
    assert search(empty(spark), some).collect() == []
    assert search(frame(spark, odd_texts()), none).collect() == []
    assert search(frame(spark, [(1, None), (2, "")]), some).collect() == []
