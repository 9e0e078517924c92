from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfline.llm import packing
from shelfline.llm.tokens import VOCABULARY, Encoder
from tests.llm.cases import empty, frame, odd_texts, prose


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=9))
def test_bound_and_best_fit_bracket_the_optimum(lengths):
    sizes = np.array(lengths, np.int64)
    bins, offsets, left = packing.best_fit(sizes, 24)
    fewest = optimum(sorted(lengths, reverse=True), 24)
    assert packing.least_bins(sizes, 24) <= fewest <= len(left)
    assert (np.bincount(bins, sizes, len(left)) + left == 24).all() if lengths else not len(left)


def optimum(lengths, capacity):
    best = len(lengths)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= lengths[at]:
                rooms[i] -= lengths[at]
                place(at + 1, rooms)
                rooms[i] += lengths[at]
        place(at + 1, [*rooms, capacity - lengths[at]])

    place(0, [])
    return best


def test_functions_beat_the_volume_bound():
    assert packing.least_bins(np.array([13] * 7), 24) == 7
    assert packing.least_bins(np.array([9] * 8), 24) == 4


def test_both_libraries_give_the_same_ids():
    encoder = Encoder()
    texts = [t or "" for _, t in odd_texts()]
    texts += ["it's I'LL we've 'sx", "a\n\n\n b\t c  ", "<|endoftext|> x", "naïve façade ÑÇß 1234 5,6", "\x00\x1c\x85"]
    texts += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "日<|endoftext|>語"]
    untouched = Tokenizer.from_file(VOCABULARY)
    for text in texts:
        slow = untouched.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text).tolist() == slow
        if "<|endoftext|>" not in text:
            assert encoder.fast.encode_ordinary(text) == slow
    assert 50256 in encoder.ids("a <|endoftext|> b")


def check(rows, pieces, capacity):
    encoder = Encoder()
    texts = [np.append(encoder.ids(t or ""), 0).astype("<u4") for _, t in rows]
    expected = defaultdict(int)
    for (doc_id, _), ids in zip(rows, texts):
        for piece, (start, length) in enumerate(packing.cut(len(ids), capacity)):
            crc = zlib.crc32(ids[start : start + length].tobytes())
            expected[doc_id, piece, start, length, crc] += 1
        if len(ids) <= capacity:
            assert len(packing.cut(len(ids), capacity)) == 1
    for r in pieces:
        expected[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] -= 1
    assert not any(expected.values())
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity,group_rows", [(2048, 8192), (64, 20)])
def test_every_piece_has_one_place(spark, capacity, group_rows):
    rows = odd_texts() + [(n, prose(n, n % 90)) for n in range(100, 260)]
    found = packing.pack_documents(frame(spark, rows), capacity, group_rows)
    pieces = found.collect()
    used = check(rows, pieces, capacity)
    bound = packing.least_bins(np.array([r.length for r in pieces]), capacity)
    assert bound <= used <= bound + 1 + bound // 100


@pytest.mark.parametrize("least,most", [(1, 2048), (500, 900)])
def test_exchange_of_small_groups_comes_near_one_group(spark, least, most):
    random = np.random.Generator(np.random.PCG64(1))
    lengths = random.integers(least, most + 1, 3000)
    rows = [(n, int(x)) for n, x in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "lot bigint, length bigint").cache()
    packed = packing.pack_pieces(pieces, 2048, 40).cache()
    alone = len(packing.best_fit(lengths, 2048)[2])
    proof = packing.certificate(packed).first()
    assert packed.count() == 3000 and packed.select("lot").distinct().count() == 3000
    assert proof["least_bins"] == packing.least_bins(lengths, 2048) <= proof["bins"] <= 1.01 * alone


def test_empty(spark):
    found = packing.pack_documents(empty(spark))
    assert found.count() == 0 and found.columns[-2:] == ["sequence_id", "offset"]
