"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, size double, part int"
STEMS = "the of and rain wind market house river stone light green paper table window garden".split()


def texts(seed: int = 1, n: int = 40) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choices(STEMS, k=rng.randint(1, 90))) + "." for _ in range(n)]


def odd_rows(n: int = 40):
    rows = []
    some = texts(n=n)
    for i, t in enumerate(some):
        rows.append((i, t, ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4]))
    base = some[0] + " " + some[1] + " " + some[2]
    near = base.replace("river", "RIVER", 1)
    rows += [
        (100, None, None, None), (101, "", "en", "a"), (102, " \n\t ", "en", "b"),
        (103, base, "en", "a"), (104, near, "en", "c"), (105, base, None, "a"), (105, base, None, "a"),
        (106, "x" * 5000 + "\n" + "word " * 6000, "en", "c"), (107, "<|endoftext|> a<|endoftext|>  b\n\n c", "en", "a"),
        (108, "é😀　ü\x1c \x85 \xa0x", "de", "b"), (109, "12 34 ## !!", "de", "b"),
        (None, "no id here", "en", "a"), (None, None, None, None), (110, "Licensed under CC BY-NC 4.0.", "en", "a"),
    ]
    return [(i, t, lang, s, 1, "clash", 2, 0.5, 3) for i, t, lang, s in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
