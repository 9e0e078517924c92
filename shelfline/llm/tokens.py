"""Token ids of texts by a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(vocabulary: str = VOCABULARY) -> list[str]:
    """Names that the vocabulary takes as tokens wherever they stand."""
    with open(vocabulary, encoding="utf-8") as file:
        return [token["content"] for token in json.load(file).get("added_tokens", [])]


class Encoder:
    """Ids of the `vocabulary` file.  `ranks` is the same vocabulary for a faster library, whose
    ids are equal; texts with characters that two libraries' Unicode tables may class differently
    (beyond Latin) or with the name of an `added` token go to the slower one, which defines the
    ids.  Pass the names along to tasks: reading them takes as much memory as the vocabulary."""

    def __init__(
        self, vocabulary: str = VOCABULARY, ranks: str = RANKS, added: list[str] | None = None
    ):
        self.vocabulary, self.slow = vocabulary, None
        self.added = added_tokens(vocabulary) if added is None else added
        with open(ranks, "rb") as file:
            pairs = [line.split() for line in file.read().splitlines() if line]
        self.fast = tiktoken.Encoding(
            "ranks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
            special_tokens={},
        )

    def ids(self, text: str) -> np.ndarray:
        """The ids, as little-endian 32-bit numbers; an added token's name is that token."""
        plain = text.isascii() or max(text) < "ɐ"
        if plain and not any(name in text for name in self.added):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        if self.slow is None:
            self.slow = Tokenizer.from_file(self.vocabulary)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
