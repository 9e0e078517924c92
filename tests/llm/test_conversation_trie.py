"""The conversation trie and list ranking against plain versions."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from shelfline.llm.conversation_trie import conversation_trie, ordered_turns, prefix_trie
from shelfline.llm.conversation_trie import rebuilt_sequences
from shelfline.llm.list_ranking import rank_list

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(said)] for c, said in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, said in own.items():
        if rebuild:
            h = zlib.crc32(str(c).encode()) % 9
            said = own.get(c - c % 5, [])[:h] + said[h:]
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
            if d:
                children[tuple(said[: d - 1])].add(tuple(said[:d]))
        ends[tuple(said)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(who),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(who),
            len(children.get(node, ())),
            leaves[node],
            saved[node],
            sha256(",".join(map(str, sorted(ends.get(node, ())))).encode()).hexdigest(),
        )
        for node, who in members.items()
    )


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def odd_rows():
    rows = [(7, n, "user" if n % 2 == 0 else "assistant", f"t{n}") for n in range(400)]  # hot
    rows += [(5, n, "user", f"five {n}") for n in range(9)]
    rows += [(6, n, "user", "one") for n in range(3)]
    rows += [(c, n, "user", f"same {n}") for c in range(100, 160) for n in range(4)]  # copies
    rows += [(9, None, None, None), (9, 0, "", None), (9, 1, "ab", "c"), (9, 2, "a", "bc")]
    rows += [(31, 0, "user", "only"), (1024, 5, "user", "late"), (-7, 0, "user", "minus é日")]
    rows += [(None, 0, "user", "no conversation"), (200, 1, "x" * 50, "long " * 40_000)]
    rows += [(201, 1, "user", "twice"), (201, 1, "user", "twice")]
    return rows


def test_trie_equals_plain_version_on_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS place", "0 AS depth", "1 AS f1")
    assert found(conversation_trie(df.repartition(5))) == plain(rows)


def test_conversations_as_they_are(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(conversation_trie(df, rebuild=False)) == plain(rows, rebuild=False)


def test_blocks_and_mating_change_nothing(spark):
    pick = random.Random(3)
    rows = [
        (c, n, "user", pick.choice("abc")) for c in range(60) for n in range(pick.randrange(1, 7))
    ]
    parts = rebuilt_sequences(ordered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert found(prefix_trie(*parts, block_rows=16, last_rows=4)) == plain(rows)


def test_empty_table_has_no_node(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


@pytest.mark.parametrize("block_rows", [1, 8, 1000])
def test_list_ranking_of_any_order(spark, block_rows):
    order = list(range(120))
    random.Random(block_rows).shuffle(order)
    arcs = [(a, b) for a, b in zip(order, [*order[1:], -1])]
    ranks = rank_list(spark.createDataFrame(arcs, "arc bigint, next bigint"), block_rows, 5)
    assert sorted((place, arc) for arc, place in ranks.collect()) == list(enumerate(order))
