import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import runs, training
from spanloom.sources.sinks import append_ledger, read_ledger


def test_quota_equals_the_pass_in_order(spark):
    import hashlib
    import random

    r = random.Random(1)
    docs = [(i,) for i in range(120)]
    labels = [(i, x) for i in range(120) for x in r.sample("abcde", r.randrange(3))]
    kept, n = [], {}
    for i in sorted(range(120), key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest()):
        own = {x for j, x in labels if j == i}
        if any(n.get(x, 0) < 7 for x in own):
            kept.append(i)
            for x in own:
                n[x] = n.get(x, 0) + 1
    got = training.quota_docs(spark.createDataFrame(docs, "doc_id long"), spark.createDataFrame(labels, "doc_id long, label string"), 7, 0.0, "s")
    assert sorted(x.doc_id for x in got.collect()) == sorted(kept)
    q = training.quota_rows(spark.createDataFrame(labels, "doc_id long, label string").withColumn("id", F.monotonically_increasing_id()), "label", "id", 3, 10, "s")
    assert q.count() == 10 and q.groupBy("label").count().agg(F.max("count")).first()[0] <= 3


def test_token_targets(spark):
    docs = spark.createDataFrame([(1, "Ann Lee met Bob in Rome on Monday")], "doc_id long, text string")
    tok = text.word_runs(docs).withColumnRenamed("idx", "i")
    gold = spark.createDataFrame([(1, 0, 7, "PERSON"), (1, 4, 7, "EMAIL"), (1, 12, 15, "PERSON"), (1, 19, 23, "IGNORE")], "doc_id long, start int, end int, label string")
    tags = [r.tag for r in training.token_targets(tok, gold).orderBy("i").collect()]
    assert tags == ["B-PERSON", "E-PERSON", "O", "S-PERSON", "O", "any", "O", "O"]


def test_span_means(spark):
    x = np.arange(12.0).reshape(6, 2)
    t = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "doc_id long, i int, vector array<double>")
    s = spark.createDataFrame([(1, 0, 2), (1, 3, 3)], "doc_id long, first int, last int")
    got = {(r.first, r.last): r.mean for r in training.span_means(t, s).collect()}
    assert np.allclose(got[0, 2], x[:3].mean(0)) and np.allclose(got[3, 3], x[3])


def test_items_and_shifts(spark):
    gold = spark.createDataFrame([(1, 5, 9, "A"), (1, 20, 24, "X")], "doc_id long, start int, end int, label string")
    sh = training.shifted_copies(gold, "s")
    assert sh.count() == 4 and sh.where("kind = 'shift'").join(gold, ["start", "end"], "left_semi").count() == 0
    prop = spark.createDataFrame([(1, 6, 8), (1, 40, 44), (1, 50, 54)], "doc_id long, start int, end int")
    items, counts = training.candidate_items(gold, sh, prop, spark.createDataFrame([("X",)], "label string"), 5.0, "s")
    got = {r.kind: r.n for r in counts.collect()}
    assert got["gold"] == 1 and got["excluded"] == 1 and got["negative"] == 2 and items.where("label = 'X'").count() == 0


def test_label_probabilities(spark):
    labels = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [1.0, 0.0])], "label string, vector array<double>")
    items = spark.createDataFrame([(1, 0, 2, 0.8, [2.0, 0.0])], "doc_id long, start int, end int, pb double, vector array<double>")
    p = training.label_probabilities(items, labels)
    want = np.exp([2, 0, 0]) / np.exp([2, 0, 0]).sum()
    assert np.allclose(p.first().probabilities, want)
    s = training.labelled_spans(p, {"a": "PERSON"}).first()
    assert (s.label, s.raw) == ("PERSON", "a") and s.score == pytest.approx(0.8 * (1 - want[2]))


def test_packing_and_answers(spark):
    q = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (1, 0, 3)], "window int, pos int, tokens int")
    got = [(r.first, r.last, r.fits) for r in training.packed_ranges(q, 10, 20).orderBy("window", "pos").collect()]
    assert got == [(10, 15, True), (15, 22, False), (10, 13, True)]
    b = training.bucket_batches(spark.createDataFrame([(i, 100 if i < 5 else 300) for i in range(8)], "id int, t int"), "id", "t", 512)
    assert {r.id: (r.bucket, r.batch) for r in b.collect()} == {0: (128, 0), 1: (128, 0), 2: (128, 0), 3: (128, 0), 4: (128, 1), 5: (512, 0), 6: (512, 1), 7: (512, 2)}
    a = spark.createDataFrame([(["x", "y"], {"x": 1.0, "y": 0.0}), (["x", "y"], {"x": 1.0}), (["x"], None)], "options array<string>, answer map<string,double>")
    assert [r.status for r in training.checked_answers(a).collect()] == ["ok", "error", "error"]
    p = spark.range(1).select(training.prompt(F.lit("choice"), F.array(F.lit("a"), F.lit("b")), F.lit("txt")).alias("p")).first().p
    assert p == "Question: choice\n01: a\n02: b\nText: txt"


def test_units_resume_and_caps(spark, tmp_path):
    path, calls = str(tmp_path / "led"), []

    def ok(n):
        return lambda: calls.append(n) or 3

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        runs.run_units(spark, path, "s", {"a": ok("a"), "b": broken}, "k", "1", 5.0)
    assert runs.run_units(spark, path, "s", {"a": ok("a"), "b": ok("b")}, "k", "1", 5.0) == ["b"] and calls == ["a", "b"]
    append_ledger(spark, path, {"unit": "x", "stage": "s", "hours": 9.0, "status": "failed", "key": "k"})
    with pytest.raises(runs.CapReached):
        runs.run_units(spark, path, "s", {"c": ok("c")}, "k", "1", 5.0)
    assert runs.run_units(spark, path, "s", {"a": ok("a")}, "other", "1", 50.0) == ["a"]
    assert json.loads(read_ledger(spark, path).first().payload)["stage"] == "s"
    assert runs.archive_name({"r.1"}, "r") == "r.2"


def test_stage_gate():
    go = lambda **r: runs.may_run("two", ["one", "two"], {"two"}, r, 0.1)[0]
    assert go(one={"accuracy": 0.5, "kind": "baseline"}) and not go() and not go(one={"accuracy": 0.5, "partial": True})
    assert not go(one={"accuracy": 0.15, "kind": "baseline"})
    assert not go(one={"accuracy": 0.5}, p={"accuracy": 0.6, "kind": "prompted"}, t={"accuracy": 0.5, "kind": "trained"})
    assert not runs.may_run("two", ["one", "two"], set(), {"one": {}}, 0.1)[0]
