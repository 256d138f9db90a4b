import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import whitening

from .corpus import clashing

SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors, components=32):
    """Sums and covariance in fractions; {row: deviation}, eigenvalues, x."""
    x = [[math.floor(Fraction(v) * 64) + 1_000_000 for v in row] for row in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    mean = [Fraction(v, n) for v in s]
    cov = [[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    e, q = np.linalg.eigh(np.array(cov))
    return dev, e[::-1][:components], q[:, ::-1][:, :components], np.array([[float(r[j] - mean[j]) for j in range(d)] for r in x]), float(np.trace(np.array(cov)))


def check(got, vectors):
    dev, e, q, y, trace = brute(vectors)
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    k = len(by)
    assert sorted(by) == list(range(1, k + 1)) and all(len(x) == len(vectors) for x in by.values())
    w = np.array([[by[c + 1][i].whitened for c in range(k)] for i in range(len(vectors))])
    want = y @ q[:, :k] / np.sqrt(e[:k])
    sign = np.sign((w * want).sum(0))
    assert np.allclose(w, want * sign, atol=1e-6)
    for c in range(k):
        for i, r in by[c + 1].items():
            assert r.n == len(vectors) and r.deviation == dev[i] and r.explained == pytest.approx(e[c] / trace, rel=1e-9) and r.identity_error < 1e-9
    return k


def test_matches_fractions(spark):
    r = np.random.default_rng(1)
    rows = (r.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.3]).tolist()
    rows += rows[:20]  # repeated rows count as often
    d = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], SCHEMA).repartition(7)
    assert check(whitening.whiten(clashing(d)).collect(), rows) == 6


def test_huge_numbers_stay_exact(spark):
    """Sums and products far beyond 64 bits, next to differences of one."""
    r = random.Random(3)
    rows = [[float(r.randrange(-2**50, 2**50)), float(2**45) + r.randrange(50) / 64, r.random() * 1e6] for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    dev, e, *_ = brute(rows)
    got = whitening.whiten(d).collect()
    assert {x.vec_id: int(x.deviation) for x in got if x.deviation is not None} == {i: v for i, v in enumerate(dev) if v < 10**38}
    x = whitening.whole(np.array(rows) * 2.0**40)
    s = whitening.scatter(x)
    y = [[int(v) for v in row] for row in x]
    assert all(s[i, 1 + j] == sum(a[i] * a[j] for a in y) for i in range(3) for j in range(3)) and [int(v) for v in s[:, 0]] == [sum(a[i] for a in y) for i in range(3)]


def test_blocks_add_up(spark, monkeypatch):
    """More rows than a product of limbs may hold at once, more tasks than one adds up."""
    monkeypatch.setattr(whitening, "LIMB_ROWS", 16)
    x = np.random.default_rng(4).integers(-2**40, 2**40, (100, 3))
    want = x.astype(object).T @ x.astype(object)
    assert (whitening.scatter(x)[:, 1:] == want).all() and (whitening.scatter(x)[:, 0] == x.astype(object).sum(0)).all()
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rows = np.random.default_rng(5).normal(size=(200, 4)).tolist()
    assert check(whitening.whiten(spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(20)).collect(), rows) == 4


def test_invalid_rows_and_low_rank(spark):
    r = np.random.default_rng(2)
    rows = [[float(a), float(a) * 2, float(b), 7.0] for a, b in r.integers(-9, 9, (50, 2))]  # rank 2
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [0.0, 0.0, 0.0, float("-inf")]), (905, [])]
    d = spark.createDataFrame([*enumerate(rows), *bad], SCHEMA)
    got = whitening.whiten(d).collect()
    assert check(got, rows) == 2 and {x.vec_id for x in got} == set(range(50))


def test_lengths_are_lists_of_their_own(spark):
    r = np.random.default_rng(6)
    a, b = r.normal(size=(40, 3)).tolist(), r.normal(size=(30, 2)).tolist()
    got = whitening.whiten(spark.createDataFrame([*enumerate(a), *((100 + i, v) for i, v in enumerate(b))], SCHEMA)).collect()
    assert check([x for x in got if x.vec_id < 100], a) == 3
    assert check([x.__class__(**(x.asDict() | {"vec_id": x.vec_id - 100})) for x in got if x.vec_id >= 100], b) == 2


def test_single_and_empty(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_floats_are_doubles(spark):
    rows = np.random.default_rng(7).normal(size=(50, 5)).astype(np.float32)
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert check(whitening.whiten(d).collect(), rows.astype(float).tolist()) == 5
