from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from shelfline.llm import decontaminate as dc
from tests.llm.cases import ALNUM, ASCII_LOWER, CLASHES, empty, frame, odd_texts, ordered, prose, tuples

NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return ALNUM.findall((text or "").translate(ASCII_LOWER))


def plain(rows, items):
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item_id))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return ordered(out)


def plain_near(rows, items, slop=2):
    """(doc_id, windows in proximity) of every row, from the rarest place of each window."""
    texts = [(doc_id, words(text)) for doc_id, text in rows]
    uses = Counter(word for _, w in texts for word in w)
    windows = {
        tuple(w[i : i + 10]) for w in (words(t) for _, t in items) for i in range(max(1, len(w) - 9) if w else 0)
    }
    out = []
    for doc_id, w in texts:
        near = 0
        for window in windows:
            if not all(uses[word] for word in window):
                continue
            rarest = min(range(len(window)), key=lambda o: (uses[window[o]], o))
            starts = [p - rarest for p, word in enumerate(w) if word == window[rarest]]
            near += any(
                all(word in w[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o, word in enumerate(window))
                for s in starts
            )
        out.append((doc_id, near))
    return ordered(out)


ITEMS = [(1, prose(900, 14)), (2, prose(901, 25)), (3, "Lone-word"), (4, None), (5, "..."), (6, "two words"),
         (7, prose(902, 10)), (8, prose(900, 14)), (10, "a a a a a a a a a a a"), (11, "Éa x")]


def with_word(text, at, word):
    w = text.split()
    return " ".join([*w[:at], word, *w[at:]])


def corpus():
    extra = [
        (50, prose(5, 20) + " " + prose(900, 14).upper() + "! " + prose(6, 9)),
        (51, prose(901, 25).replace(" ", ", ")),
        (52, "x " + " ".join(prose(901, 25).split()[3:17]) + " y"),
        (53, "lone word, two words; lone-word"),
        (54, "a " * 30),
        (55, " ".join(prose(902, 10).split()[:9])),
        (56, "Éa X éa x ÉA x"),
        (57, prose(902, 10) + " " + prose(902, 10)),
        (58, with_word(prose(900, 14), 7, "moreover")),
        (59, with_word(with_word(prose(901, 25), 7, "and so"), 20, "on it goes")),
        (60, " ".join(reversed(prose(902, 10).split()))),
    ]
    return odd_texts() + extra + extra[:2]


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS window", "2 AS term")


def test_equals_brute_force(spark):
    rows = corpus()
    docs = frame(spark, rows).drop(*["n_words"])
    got = dc.find_contamination(docs, bench(spark, ITEMS)).cache()
    assert tuples(got, *NAMES) == plain(rows, ITEMS)
    near = plain_near(rows, ITEMS)
    assert tuples(got, "doc_id", "n_near") == near
    # Found by proximity alone: passages with a word put in.
    assert {i for i, n in near if n} - {r[0] for r in plain(rows, ITEMS) if r[-1]} >= {58}


@pytest.mark.parametrize("items", [[], [(4, None), (5, "")]])
def test_nothing_to_find(spark, items):
    rows = odd_texts()
    got = dc.find_contamination(frame(spark, rows), bench(spark, items))
    assert tuples(got, *NAMES) == plain(rows, items)


def test_empty_documents(spark):
    assert dc.find_contamination(empty(spark), bench(spark, ITEMS)).count() == 0


def test_drop_keeps_columns_and_clean_rows(spark):
    rows = corpus()
    docs = frame(spark, rows, clash=False).selectExpr("*", *(f"'o' AS {c}" for c in CLASHES if c not in ("copy", "row_key")))
    left = dc.drop_contaminated(docs, bench(spark, ITEMS))
    bad = {r[0] for r in plain(rows, ITEMS) if r[5]}
    assert left.columns == docs.columns
    assert tuples(left, "doc_id") == ordered((i,) for i, t in rows if i not in bad)


def test_proximity_and_no_python(spark):
    rows = [(1, "k a b c d e"), (2, "a x b c d e"), (3, "e d c b a"), (4, "a b c x x x x d e")]
    windows = dc.item_windows(bench(spark, [(1, "a b c d e")]))
    terms = dc.window_terms(windows).selectExpr("*", "xxhash64(word) AS term")
    vocabulary = terms.select("word", "term").distinct()
    postings = dc.build_index(frame(spark, rows), vocabulary, 5)
    ranked = dc.rank_terms(terms.drop("word"), postings).cache()
    ids = postings.where("n_words IS NOT NULL").select("doc_id", *dc.ROW)
    near = dc.find_near(postings, ranked, 1).join(ids, dc.ROW)
    assert {r.doc_id for r in near.collect()} == {1, 2}
    exact = dc.find_phrases(postings, ranked).join(ids, dc.ROW)
    assert tuples(exact, "doc_id", "start") == [(1, 1)]
    plan = exact._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
