import re

from spanloom.llm import mixing

from .corpus import clashing, frame, texts


def targets(sizes):
    """Share, cut, share the excess again, until no source is above three times its size."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {s: 0.0 for s in names}, set(names)
    left = total
    while open_ and left > 1e-9:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            out[s] += share[s]
            if out[s] >= 3 * sizes[s]:
                left += out[s] - 3 * sizes[s]
                out[s] = 3.0 * sizes[s]
                open_.discard(s)
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, got):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    assert len(got) == len(rows)
    assert sorted((str(r[0]), words(r[1]), sizes[r[3]]) for r in rows) == sorted((str(g.doc_id), g.size, g.source_size) for g in got)
    want = targets(sizes)
    by = {g.source_size: g.target for g in got}
    for s, n in sizes.items():
        assert abs(by[n] - want[s]) < 1e-6 * max(1, want[s]), (s, by[n], want[s])
        taken = sum(g.taken for g in got if g.source_size == n)
        assert abs(taken - want[s]) <= max(8, 0.02 * want[s]), (s, taken, want[s])
    assert all(0 <= g.taken <= 3 * g.size for g in got)


def test_mix(spark):
    rows = texts()
    check(rows, mixing.mix(clashing(frame(spark))).collect())


def test_capped_sources_and_reruns(spark):
    rows = [(i, "w " * (5 if s == "a" else 200), "en", s, 0) for i, s in enumerate(["a", "b", "c", "d", None] * 8)]
    got = mixing.mix(frame(spark, rows)).collect()
    sizes = {g.source_size: g.target for g in got}
    assert sizes[40] <= 120
    again = mixing.mix(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_schedule_is_even(spark):
    plan = mixing.plan(spark.createDataFrame([("a", 1000, 10), ("b", 1000, 10)], "source string, source_size long, n long"), slots=1000)
    rows = mixing.schedule(plan).orderBy("slot").collect()
    assert [r.rank for r in rows if r.src == 1] == list(range(sum(r.src == 1 for r in rows)))
    for n in (30, 100, 300):  # the first slots have the right shares already
        assert abs(sum(r.src == 2 for r in rows[:n]) / n - 2 / 3) < 0.05


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None, None, None)])).collect()] == [0]
