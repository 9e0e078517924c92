from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from shelfline.llm import sharding
from tests.llm.cases import empty, frame, odd_texts, ordered, tuples


def jump(key, count):
    at = found = 0
    step = 1
    while at < count:
        found = at
        draw = int(hashlib.md5(f"{'' if key is None else key}:{step}".encode()).hexdigest()[:8], 16) >> 1
        at = int((at + 1) * (1 << 31) / (draw + 1))
        step += 1
    return found


def test_rows_and_slots(spark):
    rows = odd_texts() + [(n, f"t{n}") for n in range(100, 700)] + [(42, "same")] * 30
    docs = frame(spark, rows).drop("size", "shard", "slot")
    got = sharding.shard_documents(docs, 8)
    expected = [
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", jump(i, 8), jump(i, 9))
        for i, t in rows
    ]
    assert tuples(got, "doc_id", "size", "text_crc32", "law", "shard", "grown_shard") == ordered(expected)
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(a == b or b == 8 for *_, a, b in expected)


def test_shares_are_even_and_growth_moves_little(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id")
    got = rows.select(sharding.jump_shards(rows["doc_id"], [40, 41, 80]).alias("s")).collect()
    counts = Counter(r.s[0] for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) < 1.25 * min(counts.values())
    moved = sum(r.s[0] != r.s[1] for r in got)
    assert 300 < moved < 700
    assert all(r.s[2] >= 40 or r.s[2] == r.s[1] == r.s[0] for r in got if r.s[1] < 40)


def test_one_shard_empty_and_bad_input(spark):
    docs = frame(spark, odd_texts(), clash=False)
    assert {r.shard for r in sharding.shard_documents(docs, 1).collect()} == {0}
    assert sharding.shard_documents(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(docs.selectExpr("*", "1 AS slot"), "doc_id", 4, ["doc_id"])
    with pytest.raises(ValueError):
        sharding.shard(docs, "doc_id", 0, ["doc_id"])
    plan = sharding.shard_documents(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "SinglePartition"))
