"""Fixtures of the operators' tests: rows with nulls, ties, repeats, long texts and clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = ("score", "size", "w", "h", "n", "key", "class", "p", "rank", "row", "kept", "start", "t", "_t", "gone", "_gone", "_toxic", "digest", "_digest", "_id", "_e", "_words", "_lines")


def prose(r: random.Random, n: int) -> str:
    stock = ["al", "ber", "cor", "dan", "el", "fin", "gor", "hal", "in", "jor", "kel", "lom", "mar", "nor", "or", "pel", "quin", "ros", "sol", "tur"]
    words = ["".join(r.choice(stock) for _ in range(r.randrange(1, 4))) for _ in range(n)]
    lines, i = [], 0
    while i < n:
        k = r.randrange(6, 14)
        lines.append(" ".join(words[i:i + k]) + ".")
        i += k
    return "\n".join(lines)


def texts(seed: int = 7) -> list[tuple]:
    r = random.Random(seed)
    base = [prose(r, r.choice([3, 30, 80, 200])) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 3]) for i in range(12)]  # exact copies
    for i in range(6):  # near copies: a word of a long text changed
        w = base[5].split(" ")
        w[i % len(w)] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, prose(r, 20000)), (304, "x" * 50000), (305, "éß \U0001f600 café " * 5), (None, base[0]), (0, base[0]), (306, "A b c d")]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s1", "s2", None]), None if t is None else len(t)) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASH})
