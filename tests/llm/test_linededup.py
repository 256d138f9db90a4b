import random

import pytest
import xxhash

from spanloom.llm import linededup

from .corpus import SCHEMA, clashing, frame, texts


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


@pytest.mark.parametrize("k", range(4))
def test_within(k):
    r = random.Random(k)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randrange(12)))
        b = list(a)
        for _ in range(r.randrange(5)):
            i = r.randrange(len(b) + 1)
            b[i:i + r.randrange(2)] = r.choice(["", "a", "b"])
        b = "".join(b)
        assert linededup.within(a, b, k) == (lev(a, b) <= k), (a, b)


def norm(x):
    import re

    return re.sub(" +", " ", re.sub("[\t\x0b\x0c\r]", " ", x)).strip(" ")


def text_hash(t):
    return linededup.signed(xxhash.xxh64_intdigest((t or "").encode(), 42))


def brute(rows):
    places = sorted({(i, text_hash(t), k, norm(x)) for i, t, *_ in rows if i is not None for k, x in enumerate((t or "").split("\n")) if len(norm(x)) >= linededup.MIN_CHARS})
    names = sorted({p[3] for p in places})
    group = {x: x for x in names}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in names:
        for b in names:
            if a < b and abs(len(a) - len(b)) <= 2 and lev(a, b) <= linededup.budget(min(len(a), len(b))):
                group[root(a)] = root(b)
    by = {}
    for *at, x in places:
        by.setdefault(root(x), []).append(tuple(at))
    return sorted((*at, min(v)[0], min(v)[2], len(v), at != min(v)) for v in by.values() if len(v) > 1 for at in v)


def edited(seed):
    r = random.Random(seed)
    rows = [x for x in texts(seed) if x[1] is None or len(x[1]) < 2000]
    out = []
    for n, (i, t, *rest) in enumerate(rows):
        if t and n % 2:
            c = list(t)
            for _ in range(r.randrange(5)):
                k = r.randrange(len(c))
                c[k:k + r.randrange(2)] = r.choice(["", "e", "é", " "])
            t = "".join(c)
        out.append((i, t, *rest))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = edited(seed)
    got = linededup.line_classes(clashing(frame(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert len(got) > 20


def test_large_groups(spark):
    """Lines that share most of their text, far and near ones, meet by spread() as they do pair by pair."""
    from pyspark.sql import functions as F

    r = random.Random(4)
    base = "the harbour master wrote in his book that no ship had come in since the spring tides ended early"
    w = base.split()
    rows = []
    for i in range(120):
        v = list(w)
        for _ in range(r.randrange(1, 3)):
            v[r.randrange(len(w))] = "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 8)))
        c = list(" ".join(v))
        if i % 3 == 0:
            c[r.randrange(len(c))] = "q"
        rows.append((i, "".join(c), None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    lines = linededup.read(docs)
    places = lines.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min_by("t", "doc_id").alias("t"), F.min("line").alias("line"), F.count("*").alias("n"))
    def groups(g):
        links = [(x.a, x.b) for x in linededup.similar(docs, lines, places, g).collect()]
        label = {x: x for e in links for x in e}
        for _ in label:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    one, two = groups(10**9), groups(0)
    assert one == two and len(one) > 5
    assert sorted(tuple(x) for x in linededup.line_classes(docs).collect()) == brute(rows)


def test_lines_near_one_pivot_give_a_star(spark):
    """600 lines that differ in one place: linked to one of them each, not all to all."""
    from pyspark.sql import functions as F

    base = "the harbour master wrote in his book that no ship {} had come in since the spring tides"
    docs = spark.createDataFrame([(i, base.format(chr(0x4E00 + i)), None, None, None) for i in range(600)], SCHEMA)
    lines = linededup.read(docs)
    places = lines.select("h", "doc_id", "t", "line", F.lit(1).alias("n"))
    assert linededup.similar(docs, lines, places).count() < 1200
    got = linededup.line_classes(docs).collect()
    assert len(got) == 600 and {(r.class_doc_id, r.n_lines) for r in got} == {(0, 600)}


def test_repeated_ids_lose_no_unique_line(spark):
    long, own = "a line that is long enough to count as one", "a line of its own that nothing else is like"
    rows = [(i, t, "en", "s", len(t)) for i, t in [(0, long), (1, long), (1, own), (2, own + "\nx"), (2, "y\n" + own), (3, long), (3, long)]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.text) for r in linededup.drop_lines(clashing(docs)).collect())
    assert got == [(0, long), (1, own), (2, "x"), (2, "y")]
    alike = spark.createDataFrame([(4, long, None, None, 0)] * 2, SCHEMA)
    assert linededup.drop_lines(alike).count() == 2  # one row can't be told from the other
    assert sorted(tuple(x) for x in linededup.line_classes(docs).collect()) == brute(rows)


def test_chain_of_edits_is_one_class(spark):
    base = "the quick brown fox jumps over the lazy dog tonight"
    rows = [(i, base[:10] + "z" * i + base[10:], None, None, None) for i in range(7)]
    got = linededup.line_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.class_doc_id, r.n_lines) for r in got} == {(0, 7)} and len(got) == 7


def test_short_lines_repeat(spark):
    rows = [(i, f"words of text number {i} alone\n{x}\n \n", None, None, None) for i, x in enumerate(["Share", " Share\t", "share", "x", "x", "Read  more", "Read more"])]
    got = {(r.doc_id, r.line): (r.class_doc_id, r.removed) for r in linededup.line_classes(spark.createDataFrame(rows, SCHEMA)).collect() if r.line}
    assert got == {(0, 1): (0, False), (1, 1): (0, True), (3, 1): (3, False), (4, 1): (3, True), (5, 1): (5, False), (6, 1): (5, True)}


def test_drop_lines(spark):
    rows = [(1, "a line that is long enough to count\nown words of the first", "en", "s", 1), (2, "a line that is long enough to count\nshort\nother words of the second text", "en", "s", 1), (3, "a line that is long enough to count", "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0)]
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (rows[0][1], 1), 2: ("short\nother words of the second text", 36), 4: (None, None), 5: ("", 0)}


def test_empty(spark):
    assert linededup.line_classes(frame(spark, [])).collect() == []
