import random

import numpy as np
import pytest
import xxhash

from spanloom.llm import simhash

from .corpus import SCHEMA, clashing, frame, texts


def brute_fp(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(texts, budget=3):
    """A group name for each text: the least fingerprint that links reach."""
    fps = [brute_fp(t) for t in texts]
    best = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in best:
            for b in best:
                if best[b] < best[a] and bin(a ^ b).count("1") <= budget:
                    best[a], changed = best[b], True
    return [best[f] for f in fps]


def brute(rows):
    groups = brute_groups([t for _, t in rows])
    first = {g: min((i for (i, _), h in zip(rows, groups) if h == g and i is not None), default=None) for g in groups}
    return sorted(((i, f"{brute_fp(t):016x}", first[g]) for (i, t), g in zip(rows, groups)), key=str)


def test_matches_brute_force(spark):
    rows = [(r[0], r[1]) for r in texts()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(clashing(frame(spark))).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.keep_one(frame(spark, [])).collect() == []


def test_fingerprint_equals_spark_hash(spark):
    text = "one Two three FOUR five"
    w = text.lower().split()
    h = [spark.sql(f"select xxhash64('{' '.join(w[i:i + 3])}')").first()[0] % 2**64 for i in range(3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)


def forest_groups(m, i, j):
    p = list(range(m))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        p[root(a)] = root(b)
    return {frozenset(k for k in range(m) if root(k) == x) for x in {root(k) for k in range(m)}}


@pytest.mark.parametrize("seed", range(6))
def test_trie_links(seed):
    r = random.Random(seed)
    f = {r.getrandbits(64) for _ in range(60)}
    for x in list(f):
        for _ in range(r.randrange(4)):
            y = x
            for _ in range(r.randrange(1, 5)):
                y ^= 1 << r.randrange(64)
            f.add(y)
    f = np.array(sorted(f), np.uint64)
    near = [(a, b) for a in range(len(f)) for b in range(a) if bin(int(f[a]) ^ int(f[b])).count("1") <= 3]
    want = forest_groups(len(f), *(np.array(x, int) for x in zip(*near)))
    assert forest_groups(len(f), *simhash.trie_links(f, 3)) == want
    exact = [(a, b) for a, b in near if int(f[a]) >> 48 == int(f[b]) >> 48]
    want = forest_groups(len(f), *(np.array(x, int) for x in zip(*exact)))
    assert forest_groups(len(f), *simhash.trie_links(f, 3, 16)) == want


def test_wide_nodes_are_split(spark):
    r = random.Random(5)
    f = {0xABCD << 48 | r.getrandbits(12) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    f = [x - 2**64 if x >= 2**63 else x for x in sorted(f)]
    nodes = spark.createDataFrame(list(enumerate(f)), "id long, fp long")
    i, j = zip(*[(r.a, r.b) for r in simhash.links(nodes, 3, node_rows=20).collect()])
    near = [(a, b) for a in range(len(f)) for b in range(a) if bin((f[a] ^ f[b]) % 2**64).count("1") <= 3]
    assert forest_groups(len(f), np.array(i), np.array(j)) == forest_groups(len(f), *(np.array(x) for x in zip(*near)))


def test_split_nodes_keep_links_that_are_folded(spark, monkeypatch):
    """u1 and u2 under one prefix are 6 bits apart and meet by v under the other alone; links on one side are folded too."""
    monkeypatch.setattr(simhash, "HELD", 4)
    v = 0xABCD80 << 40
    u = [0xABCD00 << 40 | 3, 0xABCD00 << 40 | 3 << 20]
    f = np.array(sorted([v, *u, *(u[0] ^ 1 << b for b in range(30, 38)), *(v ^ 1 << b for b in range(30, 38))]), np.uint64)
    side = f >> np.uint64(40)
    near = [(a, b) for a in range(len(f)) for b in range(a) if side[a] != side[b] and bin(int(f[a]) ^ int(f[b])).count("1") <= 3]
    want = forest_groups(len(f), *(np.array(x, int) for x in zip(*near)))
    assert forest_groups(len(f), *simhash.trie_links(f, 3, 16, (24, 0xABCD00, 0xABCD80))) == want


@pytest.mark.parametrize("seed", range(3))
def test_wide_nodes_with_folded_links(spark, monkeypatch, seed):
    r = random.Random(seed)
    f = sorted({0x1BCD << 48 | r.getrandbits(14) << r.choice([0, 20, 34]) for _ in range(300)})
    f = np.array(f, np.uint64)
    near = [(a, b) for a in range(len(f)) for b in range(a) if bin(int(f[a]) ^ int(f[b])).count("1") <= 3]
    for held in (1, 50):
        monkeypatch.setattr(simhash, "HELD", held)
        for x, y in {(int(f[a]) >> 40, int(f[b]) >> 40) for a, b in near}:
            x, y = min(x, y), max(x, y)
            sides = [{int(f[a]) >> 40, int(f[b]) >> 40} == {x, y} for a, b in near]
            part = np.flatnonzero(np.isin(f >> np.uint64(40), [x, y]))
            at = {k: i for i, k in enumerate(part.tolist())}
            pairs = [(at[a], at[b]) for (a, b), ok in zip(near, sides) if ok]
            want = forest_groups(len(part), *(np.array(z, int) for z in zip(*pairs)))
            assert forest_groups(len(part), *simhash.trie_links(f[part], 3, 16, (24, x, y))) == want


def test_keep_one(spark):
    rows = texts()
    kept = [r.doc_id for r in simhash.keep_one(frame(spark)).collect()]
    want = {c for _, _, c in brute([(r[0], r[1]) for r in rows])}
    assert sorted(kept) == sorted(want)


def test_keep_one_with_repeated_ids(spark):
    """Rows (1, A), (5, A), (5, B), (7, B): B stays in one row; rows alike in id and text stay once."""
    a, b, c = ("alpha beta gamma delta", "one two three four five", "red green blue white")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (9, c), (None, a), (None, "only here as it is"), (None, "only here as it is")]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one(clashing(d)).collect()))
    assert kept == sorted([(1, a), (5, b), (9, c), (0, "only here as it is")])
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert got == {(1, 1), (5, 1), (5, 5), (7, 5), (9, 9), (None, 1), (None, None)}


def test_components(spark):
    from spanloom.llm.common import components

    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    best = {x: x for e in edges for x in e if None not in e}
    for _ in range(100):
        for a, b in edges:
            if None not in (a, b):
                best[a] = best[b] = min(best[a], best[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in best.items())
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
