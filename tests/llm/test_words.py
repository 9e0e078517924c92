from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm.words import MARKS, SPACES, find_words, hash_runs, hash_words, slices
from tests.llm.cases import ALNUM, ASCII_LOWER, SPACED

TEXTS = st.lists(st.text(alphabet="aB1 \n\té日_-. \x0b\x7f", max_size=60), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans(), st.integers(1, 40))
def test_words_and_runs_equal_plain_ones(texts, marks, limit):
    table, pattern = (MARKS, ALNUM) if marks else (SPACES, SPACED)
    seen: dict[int, tuple] = {}
    rows = 0
    for part in slices(pa.array(texts, pa.large_string()), lower=True, limit=limit):
        words = find_words(part, table)
        hashes = hash_words(part, words)
        begin, runs = hash_runs(hashes, words, 3)
        for row in range(part.rows):
            plain = pattern.findall(texts[part.first + row].translate(ASCII_LOWER))
            a, b = words.first[row], words.first[row + 1]
            spans = zip(words.begin[a:b], words.end[a:b])
            assert [part.data[x:y].tobytes().decode() for x, y in spans] == plain
            inside = (begin >= a) & (begin < b)
            expected = [tuple(plain[i : i + 3]) for i in range(len(plain) - 2)]
            assert inside.sum() == len(expected)
            for value, run in zip(runs[inside].tolist(), expected):
                assert seen.setdefault(value, run) == run
            rows += 1
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


def test_long_words_and_no_rows():
    assert list(slices(pa.array([], pa.large_string()))) == []
    part = next(slices(pa.array(["y" * 3000 + " " + "y" * 3001 + " yy"], pa.large_string())))
    hashes = hash_words(part, find_words(part, SPACES))
    assert len(np.unique(hashes)) == 3
