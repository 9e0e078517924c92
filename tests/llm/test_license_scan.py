from __future__ import annotations

from shelfline.llm import license_scan as ls
from shelfline.llm.license_texts import PHRASES, TEMPLATES
from tests.llm.cases import ALNUM, ASCII_LOWER, empty, frame, odd_texts, ordered, prose, tuples

NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def plain(rows):
    out = []
    for doc_id, text in rows:
        w = ALNUM.findall((text or "").translate(ASCII_LOWER))
        found = [
            (i, label)
            for phrase, label in PHRASES.items()
            for i in range(len(w))
            if w[i : i + len(phrase.split())] == phrase.split()
        ]
        at = [i for i, _ in found]
        out.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return ordered(out)


def corpus():
    mit, apache = TEMPLATES["mit"][1], TEMPLATES["apache"][1]
    words = mit.split()
    worn = " ".join([*words[:20], "moreover", *words[20:40], *words[42:]])
    rows = [
        (50, "MIT-License, apache  LICENSE\nmit license general public license apache license"),
        (51, prose(1) + " " + mit + " " + prose(2)),
        (52, prose(1) + " " + worn),
        (53, apache.upper()),
        (54, " ".join(words[:12])),
        (55, "Licensed under CC BY-NC 4.0. " + prose(4)),
        (56, "general public\x00license mit é license"),
        (57, (mit + " ") * 3),
    ]
    return odd_texts() + rows + rows[1:3]


def test_base_equals_plain_places(spark):
    rows = corpus()
    got = ls.scan_licenses(frame(spark, rows))
    assert tuples(got, *NAMES) == plain(rows)


def test_diagonals_find_templates(spark):
    rows = corpus()
    got = {r.doc_id: r for r in ls.scan_licenses(frame(spark, rows)).collect()}
    assert got[51].labels == got[52].labels == got[57].labels == "mit" and got[51].base_labels == ""
    assert got[53].labels == "apache" and got[55].labels == "cc-by-nc"
    assert got[51].score == 1.0 and 0.6 <= got[52].score < 1.0
    assert got[54].labels == "" and got[54].score == 0.0 and got[0].score == 0.0
    assert got[50].labels == "apache,gpl,mit" and got[50].score == 0.5


def test_many_runs_are_joined_by_shuffle(spark):
    docs = frame(spark, corpus())
    names = [*NAMES, "labels", "score"]
    assert tuples(ls.scan_licenses(docs, most_runs=0), *names) == tuples(ls.scan_licenses(docs), *names)


def test_votes(spark):
    """Neighbouring diagonals are one stretch; far ones are apart."""
    runs = spark.createDataFrame([(r, "x", 0, r, 6) for r in range(6)], "run bigint, label string, template int, at int, runs int")
    places = [(0, 10), (1, 11), (2, 13), (3, 14), (4, 90), (5, 91)]
    hits = spark.createDataFrame([(1, 1, r, p) for r, p in places], "doc_id bigint, row_key bigint, run bigint, place bigint")
    assert tuples(ls.vote(hits, runs), "first", "last", "seen") == [(10, 14, 4), (90, 91, 2)]


def test_repeated_notices(spark):
    """Notices one after the other are found however many there are."""
    names = [(label, text) for label, texts in TEMPLATES.items() for text in texts]
    rows = [(100 * n + times, (prose(n) + " ") * (times % 2) + (text + " ") * times)
            for n, (_, text) in enumerate(names) for times in (1, 2, 3, 4, 7, 50)]
    got = {r.doc_id: r for r in ls.scan_licenses(frame(spark, rows)).collect()}
    for n, (label, _) in enumerate(names):
        assert {got[i].score for i, _ in rows if i // 100 == n} == {1.0}
        assert all(label in got[i].labels.split(",") for i, _ in rows if i // 100 == n)


def test_empty(spark):
    assert ls.scan_licenses(empty(spark)).count() == 0
