import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import bootstrap, order


def test_binomial_inverts_the_distribution_function():
    r = np.random.default_rng(1)
    n = r.integers(0, 60, (200, 5))
    p, u = np.array([0.5, 0.3, 0.9, 0.0, 1.0]), r.random((200, 5))
    got = bootstrap.binomial(n, p, u)
    for i in range(200):
        for j in range(3):
            reached, k = 0.0, -1
            while reached < u[i, j] and k < n[i, j]:
                k += 1
                reached += math.comb(n[i, j], k) * p[j] ** k * (1 - p[j]) ** (n[i, j] - k)
            assert got[i, j] == k
    assert (got[:, 3] == 0).all() and (got[:, 4] == n[:, 4]).all()
    many = bootstrap.binomial(np.full((4000, 1), 10**6), np.array([0.5]), r.random((4000, 1)))
    assert abs(many.mean() - 5e5) < 5 * 500 / 4000**0.5 and abs(many.std() / 500 - 1) < 0.06


@pytest.mark.parametrize("clusters", [1, 2, 7, 37, 64])
def test_counts_follow_the_multinomial_law(clusters):
    draws = np.arange(4000)
    w = bootstrap.counts(clusters, 0, 0, draws, 5)
    assert w.shape == (4000, clusters) and (w.sum(1) == clusters).all() and w.min() >= 0
    # each count is binomial, two counts lean against one another
    law = [math.comb(clusters, k) * (1 / clusters) ** k * (1 - 1 / clusters) ** (clusters - k) for k in range(clusters + 1)]
    for c in {0, clusters // 2, clusters - 1}:
        seen = np.bincount(w[:, c], minlength=clusters + 1) / 4000
        assert np.abs(seen - law).max() < 5 * (0.25 / 4000) ** 0.5
    if clusters > 2:
        cov = np.cov(w.T)
        assert abs(np.diag(cov).mean() - (1 - 1 / clusters)) < 0.05 and abs(cov[~np.eye(clusters, dtype=bool)].mean() + 1 / clusters) < 0.01
        direct = np.random.default_rng(3).multinomial(clusters, np.full(clusters, 1 / clusters), 4000)
        assert abs((w == 0).mean() - (direct == 0).mean()) < 0.01 and abs((w**2).sum(1).mean() - (direct**2).sum(1).mean()) < 0.15 * clusters**0.5


def test_leaves_are_slices_of_the_whole():
    draws = np.arange(90, 130)
    for clusters in (5, 37, 100):
        whole = bootstrap.counts(clusters, 0, 0, draws, 2)
        for level in (1, 2, 3):
            got = np.concatenate([bootstrap.counts(clusters, j, level, draws, 2) for j in range(2**level)], axis=1)
            assert (got == whole).all()


def direct(x, stat, n_boot, seed):
    """x: (clusters, features) of one system; statistics of every draw, weights drawn at once."""
    w = bootstrap.counts(len(x), 0, 0, np.arange(n_boot), seed)
    return stat(w @ x)


def frame(spark, systems):
    """{(system, run): (clusters, features)} as rows; zeros are left out but for the first feature."""
    rows = [(s, r, f"c{i:03}", j, float(v)) for (s, r), x in systems.items() for i, row in enumerate(x) for j, v in enumerate(row) if v or j == 0]
    return spark.createDataFrame(rows, "system string, run int, cluster string, feature int, value double").repartition(5)


def test_draws_match_one_matrix_product(spark):
    r = np.random.default_rng(7)
    systems = {("a", 0): r.integers(0, 9, (41, 6)), ("a", 1): r.integers(0, 9, (41, 6)), ("b", 0): r.integers(0, 9, (41, 6))}
    got = bootstrap.drawn(frame(spark, systems), 6, bootstrap.f1, ("micro", "macro"), n_boot=600, seed=4, leaf=8)
    have = {(x.system, x.name, x.draw): x.value for x in got.collect()}
    assert len(have) == 2 * 2 * 601
    a = (direct(systems["a", 0], bootstrap.f1, 600, 4) + direct(systems["a", 1], bootstrap.f1, 600, 4)) / 2
    b = direct(systems["b", 0], bootstrap.f1, 600, 4)
    for k, name in enumerate(("micro", "macro")):
        assert [have["a", name, i] for i in range(600)] == pytest.approx(a[:, k].tolist())
        assert [have["b", name, i] for i in range(600)] == pytest.approx(b[:, k].tolist())
        assert have["b", name, -1] == pytest.approx(bootstrap.f1(systems["b", 0].sum(0, keepdims=True).astype(float))[0, k])
    d = a[:, 0] - b[:, 0]
    x = next(x for x in bootstrap.differences(got, "b").collect() if x.name == "micro")
    assert (x.lower_95, x.upper_95) == pytest.approx(tuple(np.quantile(d, [0.025, 0.975]))) and (x.one_sided_lower_95, x.one_sided_upper_95) == pytest.approx(tuple(np.quantile(d, [0.05, 0.95])))
    assert x.p_value == pytest.approx(min(1, 2 * min(((d <= 0).sum() + 1) / 601, ((d >= 0).sum() + 1) / 601)))
    assert x.difference == pytest.approx(x.value - x.baseline)


def test_paired_and_reproducible(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 3, (12, 2 * 1002))
    f = frame(spark, {("a", 0): x, ("same", 0): x, ("b", 0): r.integers(0, 3, (12, 2 * 1002))})
    once, again = (bootstrap.differences(bootstrap.drawn(d, 2004, bootstrap.pauc, ("pauc",), n_boot=300, seed=3, leaf=leaf), "a").orderBy("system").collect() for d, leaf in ((f, 4), (f.repartition(2), 100)))
    assert once == again
    assert once[1].system == "same" and once[1].difference == 0 and once[1].p_value == 1
    assert once[0].lower_95 <= once[0].difference <= once[0].upper_95


def test_clusters_must_match(spark):
    rows = [("a", 0, "x", 0, 1.0), ("a", 0, "x", 1, 2.0), ("a", 0, "y", 0, 4.0), ("a", 0, "y", 1, 1.0), ("b", 0, "x", 0, 3.0), ("b", 0, "x", 1, 1.0)]
    f = spark.createDataFrame(rows, "system string, run int, cluster string, feature int, value double")
    with pytest.raises(ValueError, match="1 of 2"):
        bootstrap.drawn(f, 2, bootstrap.mean, ("mean",), 10)
    every = spark.createDataFrame([("x",), ("y",), ("z",)], "cluster string")
    got = bootstrap.intervals(bootstrap.drawn(f, 2, bootstrap.mean, ("mean",), 400, clusters=every)).orderBy("system").collect()
    assert [x.value for x in got] == [5 / 3, 3.0] and got[1].lower_95 == got[1].upper_95 == 3.0  # draws without x are undefined
    with pytest.raises(ValueError, match="other clusters"):
        bootstrap.drawn(f, 2, bootstrap.mean, ("mean",), 10, clusters=every.where("cluster <> 'y'"))
    assert bootstrap.drawn(f.limit(0), 2, bootstrap.mean, ("mean",), 10).count() == 0


def test_means_over_documents(spark):
    rows = [(f"d{i % 9}", float(i % 7)) for i in range(100)]
    f = bootstrap.mean_features(spark.createDataFrame(rows, "cluster string, value double"), "s")
    got = bootstrap.intervals(bootstrap.drawn(f, 2, bootstrap.mean, ("mean",), 500)).first()
    assert got.value == pytest.approx(np.mean([v for _, v in rows]))
    assert got.lower_95 <= got.one_sided_lower_95 <= got.value <= got.one_sided_upper_95 <= got.upper_95


def test_running_ranks_and_sums(spark):
    r = np.random.default_rng(2)
    rows = [(i, float(x), int(k)) for i, (x, k) in enumerate(zip(np.round(r.random(500), 2), r.integers(0, 5, 500)))] + [(1000 + i, 0.5, 1) for i in range(300)]
    d = spark.createDataFrame(rows, "id int, score double, k int").repartition(3)
    for falling in (False, True):
        key = order.Falling(F.col("score")) if falling else F.col("score")
        got = {x.id: (x["rank"], x.upto) for x in order.running(d, [key, F.col("id")], {"upto": F.col("k")}, parts=7).collect()}
        total = 0
        for i, (id_, _, k) in enumerate(sorted(rows, key=lambda x: (-x[1] if falling else x[1], x[0]))):
            assert got[id_] == (i, total)
            total += k
    assert order.running(d.limit(0), [F.col("id")]).count() == 0
    plan = order.running(d, [F.col("score"), F.col("id")], {"upto": F.col("k")})._jdf.queryExecution().optimizedPlan().toString()
    alone = [x for x in plan.splitlines() if "Window" in x and "_part" in x and "windowspecdefinition(_by" in x]
    assert not alone
