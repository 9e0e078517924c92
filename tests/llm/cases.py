"""Documents with every odd case, and plain helpers for brute-force versions."""

from __future__ import annotations

import random
import re

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside or add; inputs may have them already.
CLASHES = ["n_words", "shard", "slot", "size", "mark", "copy", "row_key", "label", "kept",
           "block", "lot", "spans", "score", "hits", "place", "_text", "root"]


def prose(seed: int, words: int = 60, vocabulary: int = 300) -> str:
    pick = random.Random(seed)
    stems = ["".join(random.Random(n).choices("abdegilmnorstu", k=3 + n % 6)) for n in range(vocabulary)]
    return " ".join(pick.choices(stems, k=words))


def odd_texts() -> list[tuple[int | None, str | None]]:
    long = " ".join(prose(n, 400, 2000) for n in range(40))
    return [
        (0, prose(1)),
        (1, None),
        (2, ""),
        (3, " \n\t\x0b "),
        (None, prose(2)),
        (5, long),
        (6, prose(3)),
        (6, prose(3)),
        (7, prose(3)),
        (8, "Éa ÉA éa Ünïcode ſ K 日本 語  x\u0085y"),
        (9, "word\n" * 30),
        (10, "x" * 5000),
        (11, "one two three"),
        (12, "one two three"),
        (13, prose(1) + " tail"),
    ]


def frame(spark, rows, clash: bool = True):
    data = [(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows]
    df = spark.createDataFrame(data, SCHEMA)
    if clash:
        for name in CLASHES:
            df = df.selectExpr("*", f"'other' AS `{name}`")
    return df


def empty(spark):
    return frame(spark, [])


def tuples(df, *names) -> list[tuple]:
    rows = [tuple(r[n] for n in names) for r in df.select(*names).collect()]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def ordered(rows) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
