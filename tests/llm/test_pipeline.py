"""The pipeline against its operators' brute-force versions, stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from shelfline.session import hand_over, scratch_path
from tests.llm.cases import prose
from tests.llm.test_decontaminate import plain as plain_contamination
from tests.llm.test_jaccard_join import plain as plain_components
from tests.llm.test_packing import check
from tests.llm.test_quality_rules import plain as plain_quality
from tests.llm.test_secret_scan import plain as plain_secrets


@pytest.fixture(scope="module")
def folder(spark):
    item = prose(900, 14)
    rows = [(n, prose(n, 80)) for n in range(100, 200)]
    rows += [(n, " | ".join(prose(n, 80).split()) + " ***") for n in range(200, 240)]
    rows += [(240, rows[0][1]), (241, rows[1][1] + " end"), (242, prose(5) + " " + item + " " + prose(6))]
    rows += [(243, prose(7) + " password=0123456789abcdef99 " + prose(8)), (244, None), (245, "too few words")]
    path = scratch_path(spark, "folder")
    docs = [(i, t, "en", "s", len(t) if t else None) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    labels = [(n, int(n < 200), 0) for n in range(100, 240)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(hand_over(stage(spark, tables[-1], folder), name))
        if len(tables) <= len(corpus_pipeline.STAGES):
            assert tables[-1].columns == names
    rows = [sorted((r.doc_id, r.text) for r in t.collect()) for t in tables[1:-1]]
    first = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i in first if i < 200 or i > 239}
    assert {i for i, _ in rows[0]} == {i for i in good if not plain_quality(first[i])[-1]}
    one = {d for d, _, c in plain_components(rows[0]) if d == c}
    assert {i for i, _ in rows[1]} == one and not one & {240, 241}
    clean = {r[0] for r in plain_contamination(rows[1], [(1, prose(900, 14))]) if not r[-1]}
    assert {i for i, _ in rows[2]} == clean and 242 not in clean
    assert [i for i, _ in rows[3]] == [i for i, _ in rows[2]]
    changed = {i for (i, a), (_, b) in zip(rows[2], rows[3]) if a != b}
    assert changed == {243} and not plain_secrets(dict(rows[3])[243])
    check(rows[3], tables[-1].collect(), 2048)


def test_run_gives_the_last_stage(spark, folder):
    done = corpus_pipeline.run(spark, folder)
    assert "sequence_id" in done.columns and 90 < done.count() < 110


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    """A pair of 0.811 at five words, which has less than 0.85 at four."""
    words = [f"w{n}" for n in range(100)]
    other = ["new" if n in (30, 60) else w for n, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, prose(1, 100))]
    assert len(plain_components(rows)) == 3 and {c for _, _, c in plain_components(rows)} == {1, 2, 3}
    expected = {d for d, _, c in plain_components(rows, 5, 80) if d == c}
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == expected == {1, 3}
