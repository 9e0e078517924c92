from __future__ import annotations

import re
from collections import Counter

import numpy as np

from shelfline.llm import quality_rules as rules
from tests.llm.cases import SPACED, empty, frame, odd_texts, ordered, prose, tuples


def plain(text: str | None) -> tuple:
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        i + k
        for i in range(len(words) - 4)
        if windows[tuple(words[i : i + 5])] > 1
        for k in range(5)
    }
    n, repeated = len(words), len(covered)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated,
            n < 10 or 100 * repeated > 20 * n)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def rows_with_junk():
    good = [(n, prose(n)) for n in range(100, 160)]
    bad = [(n, " | ".join(prose(n).split()) + " ***") for n in range(160, 220)]
    return good + bad


def test_base_counts_equal_plain_ones(spark):
    rows = odd_texts() + [(50, "a b c d e " * 4 + "#|#\n#|#\n\n \n#|#"), (51, prose(9) + "\n" + prose(9))]
    none = rules.fit_quality(rules.Sample(*(np.zeros(n) for n in (1, 0, 0, 0, 0))))
    got = rules.judge_quality(frame(spark, rows, clash=False), none)
    assert tuples(got, "doc_id", *NAMES) == ordered((i, *plain(t)) for i, t in rows)
    assert got.where("kept = base_failed").count() == 0


def test_classifier_tells_junk_and_keeps_columns(spark):
    docs = frame(spark, rows_with_junk() + odd_texts(), clash=False).selectExpr("*", "'z' AS mark")
    labels = spark.createDataFrame(
        [(n, int(n < 160)) for n in range(100, 220, 2)] + [(None, 0), (100, None), (100, 1)],
        "doc_id bigint, quality int",
    )
    model = rules.train_quality(docs, labels, sample_rows=25)
    kept = rules.filter_quality(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(100, 160)) <= ids and not ids & set(range(160, 220))
    assert kept.where("doc_id = 6").count() == 2 and not ids & {1, 2, 3, 11}
    judged = rules.judge_quality(empty(spark), model)
    assert judged.count() == 0
    assert rules.train_quality(empty(spark), labels).bias == 0.0


def test_bytes_do_not_run_over_documents(spark):
    docs = frame(spark, [(n, t) for n, t in enumerate(["ab", "", "cdefg", "x"])])
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id bigint, quality int")
    assert rules.train_quality(docs, labels).weights.shape == (rules.FAMILIES << rules.BITS,)


def test_text_keys(spark):
    """Keys of any type: the rows are judged as with numbers."""
    docs = frame(spark, rows_with_junk(), clash=False)
    labels = spark.createDataFrame(
        [(n, int(n < 160)) for n in range(100, 220, 2)], "doc_id bigint, quality int"
    )
    named = "concat('k', doc_id) AS doc_id"
    model = rules.train_quality(
        docs.selectExpr(named, "text"), labels.selectExpr(named, "quality")
    )
    kept = {r.doc_id for r in rules.filter_quality(docs.selectExpr(named, "text"), model).collect()}
    assert {f"k{n}" for n in range(100, 160)} <= kept and not kept & {f"k{n}" for n in range(160, 220)}
