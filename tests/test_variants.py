"""Sweeps in one pass against each variant by itself, and detectors by name."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spanloom.operators import detectors, leak, runs, sweeps, windows
from spanloom.plans import demo


def scored_parts(spark, sf):
    r, g, _ = demo.world(spark, sf)
    p = [demo.preds_of(r, g, s).withColumn("variant", F.lit(s)) for s in ("a", "b", "c")]
    return r, g, p


def test_curves_of_all_variants_are_those_of_each(spark, sf):
    r, g, parts = scored_parts(spark, sf)
    flat = leak.labelled_runs(r.withColumn("bin", F.lit(0)), g).drop("bin")
    got = {}
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for x in sweeps.curves(sweeps.histograms(flat, both, ["a", "b", "c", "none"])).collect():
        got.setdefault(x.variant, {})[x.k] = (x.leak, x.over)
    for name, p in zip("abc", parts, strict=True):
        want = {x.k: (x.leak, x.over) for x in leak.curve(leak.histograms(leak.labelled_runs(leak.run_bins(r, p), g))).collect()}
        assert got[name].keys() == want.keys() and len(want) == 1002
        assert all(got[name][k] == pytest.approx(want[k]) for k in want)
    assert {k: v for k, v in got["none"].items() if v != (1.0, 0.0)} == {}  # nothing predicted: nothing hidden at any threshold


def test_one_scan(spark, sf, tmp_path):
    """However many variants there are, runs and predictions are read once."""
    r, g, parts = scored_parts(spark, sf)
    leak.labelled_runs(r.withColumn("bin", F.lit(0)), g).drop("bin").write.parquet(f"{tmp_path}/runs")
    parts[0].unionByName(parts[1]).write.parquet(f"{tmp_path}/preds")
    plan = sweeps.curves(sweeps.histograms(spark.read.parquet(f"{tmp_path}/runs"), spark.read.parquet(f"{tmp_path}/preds"), ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Expand" in plan


def test_padded_scores(spark):
    d = spark.createDataFrame([(1, 0, 5, [2.0, 1.0, 0.5, 3.0], 0.25), (2, 0, 5, [800.0, 790.0, 0.0, 801.0], 900.0), (3, 0, 5, None, 0.0)], "doc_id long, start int, end int, l array<double>, n double")
    got = {(r.doc_id, r.variant): r for r in sweeps.padded(d, "l", "n", (True, False), (2, 3, 4)).collect()}
    e = [math.exp(x) for x in (2.0, 1.0, 0.5, 3.0, 0.25)]
    for size in (2, 3, 4):
        r = got[1, str(size)]
        assert r.score == pytest.approx(e[0] / (sum(e[:size]) + e[4])) and not r.says_none
        assert r.drift == pytest.approx(abs(r.score - e[0] / (e[0] + e[1] + e[4])))
        assert got[2, str(size)].says_none and got[2, str(size)].score == pytest.approx(0)
        assert got[3, str(size)].score is None


def capitals() -> type[detectors.Detector]:
    @detectors.detector("capitals")
    class Capitals(detectors.Detector):
        """Words in capitals; 40 characters at once; one label of three has an outcome, and one span is out of bounds."""

        labels = {"loud": "OTHER_PII"}

        def fits(self, text):
            return len(text) <= 40

        def predict(self, text):
            assert len(text) <= 40
            at = 0
            for w in text.split(" "):
                if w.isupper():
                    yield at, at + len(w), "loud", 0.9 if len(w) > 3 else 0.1
                if w == "odd":
                    yield at, at + 3, "odd", 1.0
                if w == "far":
                    yield at, at + 10_000, "loud", 1.0
                at += len(w) + 1

    return Capitals


CAPITALS = capitals()  # of a function, so that it travels to the workers whole


def test_detections_by_name(spark):
    text = " ".join(f"word{i} LOUD{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "odd far ABC LOUD"), (3, ""), (4, None)], "doc_id long, text string")
    found = detectors.detections(docs, "capitals", floor=0.5, words=20, stride=10).cache()
    ok = {(r.doc_id, r.start, r.end) for r in detectors.accepted(found).collect()}
    want = {(1, text.index(f"LOUD{i}"), text.index(f"LOUD{i}") + len(f"LOUD{i}")) for i in range(60)}
    assert ok == want | {(2, 12, 16)}
    assert {(r.status, r.raw): r.n for r in detectors.outcomes(found.where("doc_id = 2")).collect()} == {("unknown_label", "odd"): 1, ("bad_bounds", "loud"): 1, ("below_floor", "loud"): 1, ("ok", "loud"): 1}


def test_a_sign_at_the_edge_may_belong_to_what_was_found(spark):
    """A window that ends after the dot of an address holds a shorter address, one character before the edge."""
    text = " ".join(["w"] * 12) + " a@mail.example.com " + " ".join(["w"] * 40)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for words in range(14, 22):  # some of these end inside the address
        got = [(r.start, r.end) for r in detectors.accepted(detectors.detections(docs, "patterns", words=words, stride=7)).collect()]
        assert got == [(24, 42)], words


def test_lateral_in_sql(spark):
    fn = detectors.register(spark, "patterns")
    got = spark.sql(f"SELECT t.id, f.start, f.end, f.raw FROM VALUES (1, 'to a@b.org'), (2, ''), (3, NULL) t(id, text), LATERAL {fn}(t.text, 100) f").collect()
    assert [tuple(r) for r in got] == [(1, 103, 110, "email")]


def test_registry_refuses(spark):
    with pytest.raises(ValueError, match="no detector nobody"):
        detectors.register(spark, "nobody")
    with pytest.raises(ValueError, match="there is a detector"):
        detectors.detector("patterns")(CAPITALS)
    with pytest.raises(ValueError, match="can't name"):
        detectors.detector("no name")
    with pytest.raises(ValueError, match="don't fit"):
        windows.fitted("x" * 50, lambda t: False)


def test_archives_never_clobber(spark):
    have = [("r", {"questions": "q" * 20}, True, True), ("r.stale-qqqqqqqqqqqq", None, False, False), ("r.stale-qqqqqqqqqqqq-1", None, False, False), ("s", None, False, True), ("t", {"questions": "z"}, True, True)]
    d = spark.createDataFrame(have, "run string, hashes map<string,string>, done boolean, present boolean")
    want = spark.createDataFrame([("r", "questions", "new"), ("t", "questions", "z")], "run string, name string, value string")
    got = {r.run: (r.state, r.archive) for r in runs.run_states(d, want).collect()}
    assert got["r"] == ("archive", "r.stale-qqqqqqqqqqqq-2") and got["s"] == ("archive", "s.stale-nohash") and got["t"] == ("reuse", None)
