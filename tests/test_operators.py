"""Hand-computed cases and brute force for the operators."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import audit, build, calibration, crf, detect, leak, questions, series, spans, splits, stats, taxonomy, vectors, windows
from spanloom.schema import IGNORE, PII_TYPES, SpanError, validate_predictions

DOC = "doc_id long, text string, cluster_id string"
SPAN = "doc_id long, pos int, start int, end int, label string"
PRED = "doc_id long, start int, end int, label string, score double"


def hist_of(spark, docs, gold, preds):
    r = text.word_runs(docs).select("doc_id", "idx", "start", "end")
    return leak.labelled_runs(leak.run_bins(r, preds), gold)


def test_two_names(spark):
    docs = spark.createDataFrame([(1, "Bob met Al.", "c")], DOC)
    gold = spark.createDataFrame([(1, 0, 0, 3, "PERSON"), (1, 1, 8, 10, "PERSON")], SPAN)
    preds = spark.createDataFrame([(1, 0, 3, "PERSON", 0.9), (1, 4, 7, "PERSON", 0.4)], PRED)
    h = leak.histograms(hist_of(spark, docs, gold, preds))
    at = lambda t: leak.at_threshold(h, t).select("leak", "over").first()
    assert at(0.5).leak == pytest.approx(0.4) and at(0.5).over == 0
    assert at(0.4).over == 1 and at(0.3).over == 1
    assert leak.tuned_threshold(leak.curve(h), 0.0).first()[0] == 0.401


def test_tuning_sentinels(spark):
    h = spark.createDataFrame([("c", 901, 0, 5)], "cluster string, bin int, n_pii long, n_non long")
    assert leak.tuned_threshold(leak.curve(h), 0.0).first()[0] == 0.901
    h = spark.createDataFrame([("c", 1001, 0, 5)], "cluster string, bin int, n_pii long, n_non long")
    assert leak.tuned_threshold(leak.curve(h), 0.0).first()[0] == 1.001


def brute_bins(t, gold, preds):
    lab, bins = [0] * len(t), [0] * len(t)
    for s, e, label in gold:
        for i in range(s, e):
            lab[i] = max(lab[i], 2 if label in PII_TYPES else 1 if label == IGNORE else 0)
    run = text_runs(t)
    for s, e, score in preds:
        for a, b in run:
            if a < e and b > s:
                for i in range(a, b):
                    bins[i] = max(bins[i], 1 + int(score * 1000 + 1e-9))
    out = {}
    for i, c in enumerate(t):
        if c.isalnum() and lab[i] != 1:
            k = (bins[i], lab[i])
            out[k] = out.get(k, 0) + 1
    return out


def text_runs(t):
    import re

    return [m.span() for m in re.finditer(r"[^\W_]+", t)]


def test_histograms_equal_characters(spark):
    r = random.Random(5)
    docs, gold, preds = [], [], []
    for i in range(60):
        t = "".join(r.choice("ab1é -_.") for _ in range(r.randrange(1, 80)))
        docs.append((i, t, "c"))
        for k in range(r.randrange(6)):
            a = r.randrange(len(t))
            gold.append((i, k, a, min(len(t), a + r.randrange(1, 9)), r.choice(["PERSON", "EMAIL", IGNORE, "NOT_PII"])))
        for _ in range(r.randrange(6)):
            a = r.randrange(len(t))
            preds.append((i, a, min(len(t), a + r.randrange(1, 9)), "PERSON", r.randrange(1001) / 1000))
    got = leak.histograms(hist_of(spark, spark.createDataFrame(docs, DOC), spark.createDataFrame(gold, SPAN), spark.createDataFrame(preds, PRED)))
    want = {}
    for i, t, _ in docs:
        for (b, lab), n in brute_bins(t, [g[2:] for g in gold if g[0] == i], [(p[1], p[2], p[4]) for p in preds if p[0] == i]).items():
            x = want.setdefault((i, b), [0, 0])
            x[0 if lab == 2 else 1] += n
    assert {(x.cluster, x.bin): [x.n_pii, x.n_non] for x in got.collect()} == want


def test_pauc_steps(spark):
    points = lambda p: spark.createDataFrame(p, "over double, leak double")
    assert leak.pauc(points([(0.0, 1.0), (0.01, 0.5), (0.03, 0.1)])).first()[0] == pytest.approx(0.44)
    assert leak.pauc(points([(0.0, 1.0)])).first()[0] == pytest.approx(1.0)


def test_curve_equals_numpy(spark):
    rng = np.random.default_rng(0)
    p, n = rng.integers(0, 5, (2, 1002))
    h = spark.createDataFrame([("c", i, int(a), int(b)) for i, (a, b) in enumerate(zip(p, n))], "cluster string, bin int, n_pii long, n_non long")
    got = leak.pauc(leak.curve(h)).first()[0]
    assert got == pytest.approx(float(stats.pauc_of(p[None].astype(float), n[None].astype(float))[0]))


def test_merged_gold_and_consistency(spark):
    gold = spark.createDataFrame([(1, 0, 0, 5, "PERSON"), (1, 1, 3, 8, "EMAIL"), (1, 2, 8, 9, "PHONE"), (1, 3, 20, 22, IGNORE)], SPAN)
    assert sorted((r.start, r.end, r.label) for r in spans.merged_gold(gold).collect()) == [(0, 8, "PERSON"), (8, 9, "PHONE")]
    docs = spark.createDataFrame([(1, "Ann saw ann", "c")], DOC)
    g = spark.createDataFrame([(1, 0, 0, 3, "PERSON"), (1, 1, 8, 11, "PERSON")], SPAN)
    p = spark.createDataFrame([(1, 0, 3, "PERSON", 1.0)], PRED)
    m = leak.mention_masks(hist_of(spark, docs, g, p), g, 0.5)
    c = leak.consistency(m, docs).first()
    assert (c.groups, c.all_masked, c.cond_den, c.cond_num) == (1, 0, 1, 0)
    e = leak.exposure(m).first()
    assert (e.exposed, e.mentions) == (1, 2)


def matching(pairs, n):
    """Largest matching by augmenting paths."""
    owner = {}

    def put(p, seen):
        for g in pairs.get(p, ()):
            if g not in seen:
                seen.add(g)
                if g not in owner or put(owner[g], seen):
                    owner[g] = p
                    return True
        return False

    return sum(put(p, set()) for p in range(n))


@pytest.mark.parametrize("typed", [True, False])
@pytest.mark.parametrize("mode", ["strict", "partial"])
def test_matching(spark, typed, mode):
    r = random.Random(6)
    gold, preds = [], []
    for i in range(150):
        for k in range(r.randrange(5)):
            a = r.randrange(20)
            gold.append((i, k, a, a + r.randrange(1, 6), r.choice(["PERSON", "EMAIL", IGNORE])))
        for _ in range(r.randrange(5)):
            a = r.randrange(20)
            preds.append((i, a, a + r.randrange(1, 6), r.choice(["PERSON", "EMAIL"]), 1.0))
    g, p = spark.createDataFrame(gold, SPAN), spark.createDataFrame(preds, PRED)
    merged = {}
    for x in spans.merged_gold(g).collect():
        merged.setdefault(x.doc_id, []).append((x.start, x.end, x.label))
    got = {x.doc_id: (x.tp, x.fp, x.fn) for x in spans.matched_counts(p.select("doc_id", "start", "end", "label"), g, typed, mode).collect()}
    for i in range(150):
        mg, pr = merged.get(i, []), [x[1:4] for x in preds if x[0] == i]
        if not mg and not pr:
            continue
        fit = lambda a, b: (a[:2] == b[:2] if mode == "strict" else a[0] < b[1] and a[1] > b[0]) and (not typed or a[2] == b[2])
        pairs = {j: [k for k, y in enumerate(mg) if fit(x, y)] for j, x in enumerate(pr)}
        tp = matching(pairs, len(pr))
        ign = [x[2:4] for x in gold if x[0] == i and x[4] == IGNORE]
        free = sum(any(x[0] < b and x[1] > a for a, b in ign) and not any(x[0] < y[1] and x[1] > y[0] for y in mg) for x in pr)
        assert got[i] == (tp, len(pr) - tp - free, len(mg) - tp), i


def test_greedy_candidates(spark):
    gold = spark.createDataFrame([(1, 0, 0, 4, "PERSON"), (1, 1, 30, 34, "PERSON")], SPAN)
    preds = spark.createDataFrame([(1, 0, 4, "PERSON", 0.9), (1, 0, 3, "PERSON", 0.7), (1, 10, 12, "PERSON", 0.6), (1, 30, 34, "PERSON", 0.01)], PRED)
    c, cover = calibration.candidates(preds, gold)
    assert [r.target for r in c.orderBy(F.desc("score")).collect()] == [1, 0, 0]
    assert tuple(cover.first()) == (2, 1)


def test_suppression_and_stitching(spark):
    p = spark.createDataFrame([(1, 0, 5, "A", 0.9), (1, 4, 8, "A", 0.8), (1, 7, 9, "A", 0.7), (1, 20, 21, "A", 0.1)], PRED)
    assert sorted(r.start for r in spans.suppress(p).collect()) == [0, 7, 20]
    d = spark.createDataFrame([(1, 0, 2, "A", 0.5, 0, 0), (1, 0, 2, "A", 0.5, 1, 0), (1, 0, 2, "A", 0.4, 2, 0)], PRED + ", win int, pos int")
    assert [(r.win, r.score) for r in spans.stitch(d).collect()] == [(0, 0.5)]
    cut = spark.createDataFrame([(1, 0, 2, 0, 10, 20), (1, 5, 10, 0, 10, 20), (1, 10, 12, 10, 20, 20), (1, 18, 20, 10, 20, 20)], "doc_id long, start int, end int, win_start int, win_end int, doc_length int")
    assert sorted((r.start, r.end) for r in spans.drop_cut(cut).collect()) == [(0, 2), (18, 20)]


def test_admission(spark):
    d = spark.createDataFrame([("x", 0, 1, 5, 0.9), ("A", 3, 9, 5, 0.9), ("A", 0, 1, 5, 0.01), ("A", 0, 1, 5, 0.5)], "label string, start int, end int, length int, score double")
    got = [r.status for r in spans.admit(d, spark.createDataFrame([("A",)], "label string"), 0.05).orderBy("status").collect()]
    assert got == ["bad_bounds", "below_floor", "ok", "unknown_label"]


def test_overlap_join_cells(spark):
    r = random.Random(8)
    a = [(1, s, s + r.randrange(1, 3000)) for s in (r.randrange(6000) for _ in range(60))]
    b = [(1, s, s + r.randrange(1, 3000)) for s in (r.randrange(6000) for _ in range(60))]
    da, db = (spark.createDataFrame(x, "doc_id long, start int, end int") for x in (a, b))
    want = sorted((x[1:], y[1:]) for x in a for y in b if x[1] < y[2] and x[2] > y[1])
    got = sorted(((x.start, x.end), (x.b_start, x.b_end)) for x in spans.overlap_join(da, spans.as_b(db), cell=256).collect())
    assert got == want
    semi = sorted((x.start, x.end) for x in spans.overlap_join(da, spans.as_b(db), how="left_semi").collect())
    anti = sorted((x.start, x.end) for x in spans.overlap_join(da, spans.as_b(db), how="left_anti").collect())
    assert semi == sorted(x[1:] for x in a if any(x[1] < y[2] and x[2] > y[1] for y in b)) and len(semi) + len(anti) == len(a)


def test_holm_and_decision(spark):
    h = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")).orderBy("name").collect()
    assert [(round(r.p_holm, 6), r.reject) for r in h] == [(0.03, True), (0.06, False), (0.06, False)]
    rows = [("d1", "x", -1.0, 0.001), ("d1", "y", -1.0, 0.001), ("d2", "x", 1.0, 0.001), ("d2", "y", -1.0, 0.001)]
    r = spark.createDataFrame(rows, "dataset string, baseline string, diff double, p double")
    d = stats.decide(r, needed=1, expected=4).first()
    assert (d.family, d.won, d.holds) == (4, ["d1"], True)
    assert stats.decide(r, needed=1, expected=5).first().holds is None


def test_splits(spark):
    docs = spark.createDataFrame([(i, "t", f"c{i % 33}") for i in range(99)], DOC)
    s = splits.hash_split(docs, "cluster_id", 0.2, "v0")
    parts = {r.cluster_id: {x.part for x in s.where(F.col("cluster_id") == r.cluster_id).collect()} for r in docs.select("cluster_id").distinct().limit(5).collect()}
    assert all(len(v) == 1 for v in parts.values())
    assert s.where("part = 'calib'").select("cluster_id").distinct().count() == 7
    ids = spark.range(5000).select(F.concat(F.lit("d"), "id").alias("doc_id"))
    assert 50 < splits.dev_slice(ids, F.col("doc_id"), 0.02, "v0").where("in_dev").count() < 150
    c = splits.cluster_sample(docs, "cluster_id", 10, "v0")
    assert c.count() == 12 and c.select("cluster_id").distinct().count() == 4
    st = splits.stratified_sample(docs.withColumn("s", F.col("doc_id") % 2), 11, "s", "v0")
    assert st.count() == 11
    b = splits.repeated(docs.select("doc_id"), 250, "doc_id", "v0")
    assert b.count() == 250 and b.select("slot").distinct().count() == 250 and b.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 3


def test_balanced_selection_keeps_kinds(spark):
    rows = [(i, "positive", "name" if i < 20 else "rare") for i in range(25)] + [(100 + i, "hard_negative", None) for i in range(5)]
    d = spark.createDataFrame(rows, "id long, kind string, label string")
    base, got = splits.repeated(d, 12, "id", "s"), splits.balanced_selection(d, 12, "kind", "label", "id", "s")
    kinds = lambda x: {r.slot: r.kind for r in x.collect()}
    assert kinds(got) == kinds(base)


def jac(a, b):
    return len(a & b) / len(a | b)


def test_similar_pairs_have_full_recall(spark):
    r = random.Random(7)
    base = [[r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(base[i % 12])
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "z"
        rows.append((i, " ".join(w), "c"))
    d = spark.createDataFrame(rows, DOC)
    sh = {i: {" ".join(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t, _ in rows}
    want = {(a, b) for a in sh for b in sh if a > b and jac(sh[a], sh[b]) >= 0.8}
    assert {(x.test_id, x.train_id) for x in audit.similar_pairs(d, d, 0.8, self_join=True).collect()} == want and want


def test_similar_pairs_store_no_shingles(spark, monkeypatch):
    """What is stored is a row a document or pair at most, and only the prefixes of sets meet."""
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghij") + str(r.randrange(90)) for _ in range(80)) for _ in range(20)]
    d = spark.createDataFrame([(i, texts[i % 20] + f" x{i}", "c") for i in range(40)] + [(40, None, "c"), (41, "", "c"), (42, "two words", "c")], DOC)
    stored, keep = [], audit.stash

    def stash(df, what="cut"):
        out = keep(df, what)
        stored.append(out.count())
        return out

    monkeypatch.setattr(audit, "stash", stash)
    got = {(x.test_id, x.train_id) for x in audit.similar_pairs(d, d, 0.8, self_join=True).collect()}
    assert got == {(i + 20, i) for i in range(20)} and max(stored) <= d.count()


def test_crowded_shingles_come_last(spark):
    crowd = np.zeros(audit.CROWDS, np.int64)
    crowd[[5, 6]] = 9, 1
    d = spark.createDataFrame([(1, [5, 6, 7, 8, 9, -1, 10, 11, 12, 13]), (2, [5]), (3, []), (4, None)], "doc_id long, s array<long>")
    got = {x.doc_id: x.p for x in d.select("doc_id", audit.prefixes(spark, crowd, 0.8)(F.col("s")).alias("p")).collect()}
    assert got[1] == [-1, 7, 8] and got[2] == [5] and not got[3] and not got[4]


def test_audit_flags(spark):
    letter = "dear customer your account ending in 1234 was opened on monday and we are glad to have you with us today"
    train = spark.createDataFrame([(1, letter.replace("customer", "Ada"), "t1")], DOC)
    test = spark.createDataFrame([(2, letter.replace("customer", "Ada"), "a"), (3, letter.replace("customer", "Bob").replace("1234", "9999"), "b"), (4, "nothing like it at all here to be seen", "b"), (5, "quite another text", "c")], DOC)
    g = spark.createDataFrame([(1, 5, 8, "PERSON"), (2, 5, 8, "PERSON"), (3, 5, 8, "PERSON")], "doc_id long, start int, end int, label string")
    f = {r.doc_id: r for r in audit.audit(audit.with_skeletons(train, g), audit.with_skeletons(test, g)).collect()}
    assert set(f) == {2, 3} and f[2].near == [1] and f[3].same_skeleton and f[3].template == [1]
    flagged = spark.createDataFrame([(2, "a"), (3, "b")], "doc_id long, cluster_id string")
    assert [r.doc_id for r in audit.drop_flagged(test, flagged).collect()] == [5]
    rep = audit.report(test, flagged).first()
    assert (rep.n_test, rep.n_flagged, rep.dropped_docs) == (4, 2, 0.75)


def test_build_rejects_and_stops(spark):
    raws = [(f"d{i}", "Ann met Bob", "c", [(0, 3, "name", "Ann", "gold"), (0, 3, "name", "Ann", "gold")]) for i in range(9)] + [("d9", "short", "c", [(0, 30, "name", None, "gold")]), ("d0", "other", "c", [])]
    d = spark.createDataFrame(raws, "doc_id string, text string, cluster_id string, spans array<struct<start:int,end:int,label:string,surface:string,source:string>>")
    good, bad = build.build(d, "gretel", spark, budget=0.5)
    assert bad.count() == 2 and good.select("doc_id").distinct().count() in (8, 9)
    with pytest.raises(build.RejectBudgetExceeded):
        build.build(d, "gretel", spark)
    with pytest.raises(SpanError, match="unmapped"):
        build.build(d.withColumn("spans", F.transform("spans", lambda s: s.withField("label", F.lit("nope")))), "gretel", spark)


def test_prediction_guard(spark):
    docs = spark.createDataFrame([(1, "abc", "c")], DOC)
    validate_predictions(docs, spark.createDataFrame([(1, 0, 3, "A", 1.0)], PRED))
    for row in ((2, 0, 1, "A", 1.0), (1, 0, 4, "A", 1.0)):
        with pytest.raises(SpanError):
            validate_predictions(docs, spark.createDataFrame([row], PRED))


def test_hierarchy(spark):
    closure = taxonomy.label_closure(taxonomy.label_tree(spark))
    labels = spark.createDataFrame([("first_name", "first_name"), ("last_name", "last_name"), ("email", "email")], "raw string, node string")
    back = lambda a, b, c: {r.id: r.node for r in taxonomy.back_off(spark.createDataFrame([(1, "first_name", a), (1, "last_name", b), (1, "email", c)], "id long, raw string, p double"), labels, closure, 0.5).collect()}[1]
    assert back(0.45, 0.45, 0.1) == "person_name" and back(0.8, 0.1, 0.1) == "first_name" and back(0.4, 0.1, 0.4) == "person_name"
    pairs = {(r.a, r.b) for r in taxonomy.compatible_pairs(labels.union(spark.createDataFrame([("name", "person_name")], "raw string, node string")), closure).collect()}
    assert ("first_name", "name") in pairs and ("name", "first_name") in pairs and ("first_name", "last_name") not in pairs and ("email", "email") in pairs
    canon = {r.node: r.canonical for r in taxonomy.canonical_of_nodes(closure, spark).collect()}
    assert canon["iban"] == "ACCOUNT_NUMBER" and canon["fax"] == "PHONE" and canon["age"] == "OTHER_PII" and canon["city"] == "ADDRESS"


def test_dimension_tables(spark):
    assert taxonomy.label_map(spark).groupBy("dataset", "raw").count().where("count > 1").count() == 0
    assert {r.dataset: r.n for r in taxonomy.admissible(spark).groupBy("dataset").agg(F.count("*").alias("n")).collect()}["spy_legal"] == 7
    e = spark.createDataFrame([("LOC", "QUASI"), ("LOC", "DIRECT"), ("ZZZ", "NO_MASK"), ("ZZZ", "DIRECT")], "e string, i string")
    assert [r[0] for r in e.select(taxonomy.court_label(F.col("e"), F.col("i"))).collect()] == ["IGNORE", "ADDRESS", "NOT_PII", None]
    m = spark.createDataFrame([("x", ["eval"], False), ("y", ["eval"], True)], "name string, purposes array<string>, research_only boolean")
    assert taxonomy.licence_gate(m, "x", "eval")["name"] == "x"
    for args in (("z", "eval"), ("x", "train"), ("y", "eval")):
        with pytest.raises(PermissionError):
            taxonomy.licence_gate(m, *args)


def paths(k, n):
    return itertools.product(range(k), repeat=n)


def test_crf_equals_enumeration(spark):
    rng = np.random.default_rng(2)
    c = crf.Chain.of(1, step=rng.normal(size=(5, 5)), start=rng.normal(size=5), end=rng.normal(size=5))
    e = rng.normal(size=(5, 5))
    w = {p: c.start[p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(c.step[a, b] for a, b in zip(p, p[1:])) + c.end[p[-1]] for p in paths(5, 5)}
    z = np.logaddexp.reduce(list(w.values()))
    assert c.forward(e)[1] == pytest.approx(z)
    assert tuple(c.best(e)) == max(w, key=w.get)
    got = {(i, j): p for i, j, _, p in c.spans(e, floor=1e-9)}
    for i in range(5):
        for j in range(i, 5):
            tags = (4,) if i == j else (1, *[2] * (j - i - 1), 3)
            assert got.get((i, j), 0) == pytest.approx(sum(np.exp(v - z) for p, v in w.items() if p[i:j + 1] == tags), abs=1e-8)
    ok = np.ones((5, 5), bool)
    ok[2] = [True, False, False, False, False]
    assert c.loss(e, ok) == pytest.approx(z - np.logaddexp.reduce([v for p, v in w.items() if p[2] == 0]))
    assert crf.reachable(c, ok) and not crf.reachable(c, np.eye(5, dtype=bool)[[2, 0, 0, 0, 0]])
    d = spark.createDataFrame([(1, e.tolist()), (2, [])], "doc_id long, emissions array<array<double>>")
    assert crf.decode(d, c).orderBy("doc_id").first().path == c.best(e)
    assert crf.span_probabilities(d, c, 0.01).count() == len(c.spans(e, 0.01))


def test_windows(spark):
    long = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, long), (2, "a b"), (3, ""), (4, " ".join("x" * 150)), (5, " ".join("x" * 151) + " ")], "doc_id long, text string")
    got = {}
    for r in windows.text_windows(docs).orderBy("doc_id", "win").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert got[2] == [(0, 3)] and got[3] == [(0, 0)] and got[4] == [(0, 299)]
    assert got[1][0][0] == 0 and got[1][-1][1] == len(long) and len(got[1]) == 5
    assert len(got[5]) == 2 and got[5][-1][1] == 302
    t = spark.createDataFrame([(5,), (10,), (23,)], "n int").select("n", windows.token_windows(F.col("n"), 10, 5).alias("w")).collect()
    assert [[(x.first, x.last) for x in r.w] for r in t] == [[(0, 5)], [(0, 10)], [(0, 10), (5, 15), (10, 20), (13, 23)]]


def test_fit_windows_covers_everything(spark):
    docs = spark.createDataFrame([(1, "x" * 3000, 0), (2, " ".join("word" for _ in range(300)), 0)], "doc_id long, text string, start int")
    got = windows.fit_windows(docs, lambda t: len(t) <= 500).collect()
    for d, n in ((1, 3000), (2, 1499)):
        w = sorted((r.start, r.end) for r in got if r.doc_id == d)
        assert all(e - s <= 500 for s, e in w) and w[0][0] == 0 and max(e for _, e in w) == n
        reach = 0
        for s, e in w:
            assert s <= reach + 1  # a space between tokens may fall between windows
            reach = max(reach, e)


def test_propagation(spark):
    t = "Mr. Jo Smith paid. Later Jo Smith left; smith stayed. ID ab12 and ab12 and ab123."
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    p = spark.createDataFrame([(1, 4, 12, "PERSON", 0.9), (1, t.index("ab12"), t.index("ab12") + 4, "OTHER_PII", 0.8)], PRED)
    got = detect.propagate(docs, p).where("propagated").collect()
    assert sorted(t[r.start:r.end] for r in got) == ["Jo Smith", "ab12"]


def test_answers_and_probes(spark):
    rows = [("choice", ["a", questions.NONE], None, [0.8, 0.2]), ("choice", ["a", questions.NONE], None, [0.1, 0.9]), ("score", ["0", "1", "2"], [0.0, 1.0, 2.0], [1.0, 1.0, 2.0])]
    d = spark.createDataFrame(rows, "type string, options array<string>, values array<double>, probabilities array<double>")
    a = questions.answers(d, 0.2).collect()
    assert [r.choice for r in a] == ["a", questions.NONE, "2"] and a[2].score == pytest.approx(1.25) and a[0].abstained is False
    r = questions.redaction_score(questions.answers(d.where("type = 'choice'"))).collect()
    assert [round(x.redaction, 6) for x in r] == [0.8, 0.1]
    bad = spark.createDataFrame([("choice", ["a", "b"], None, [0.0, 0.0])], d.schema)
    with pytest.raises(Exception, match="invalid probability"):
        questions.answers(bad).collect()


def test_auroc_with_ties(spark):
    r = random.Random(9)
    rows = [(r.randrange(6) / 5, r.randrange(2)) for _ in range(80)]
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert calibration.auroc(spark.createDataFrame(rows, "score double, target int")).first()[0] == pytest.approx(want)


def test_adaptive_ece_splits_like_arrays(spark):
    rng = np.random.default_rng(3)
    p, y = np.round(rng.random(47), 2), rng.integers(0, 2, 47)
    order = np.argsort(p, kind="stable")
    want = sum(len(b) / 47 * abs(p[b].mean() - y[b].mean()) for b in np.array_split(order, 15))
    d = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "id int, score double, target int")
    assert calibration.adaptive_ece(d, "id").first()[0] == pytest.approx(want)
    assert calibration.fit_temperature(d.withColumn("score", F.lit(0.5) + (F.col("target") - 0.5) * 0.2)) < 0.2


def rising(rows):
    """{score: fit} by the least of the greatest means: the rising fit in its closed form."""
    x = sorted({s for s, _ in rows})
    k, t = ([sum(f(y) for s, y in rows if s == v) for v in x] for f in (lambda y: 1, lambda y: y))
    mean = lambda a, b: sum(t[a:b + 1]) / sum(k[a:b + 1])
    return {v: max(min(mean(a, b) for b in range(i, len(x))) for a in range(i + 1)) for i, v in enumerate(x)}


def test_isotonic_fits_match_the_closed_form(spark):
    r = random.Random(4)
    rows = [(r.randrange(40) / 40, int(r.random() < 0.5), x) for x in "A" * 120 + "B" * 60 + "C" * 5] + [(0.2, 1, None)]
    d = spark.createDataFrame(rows, "score double, target int, label string").repartition(5)
    blocks = calibration.isotonic_blocks(d, least=50)
    fits = {x: rising([(s, t) for s, t, y in rows if x is None or y == x]) for x in ("A", "B", None)}
    got = calibration.isotonic(d, blocks).collect()
    assert len(got) == len(rows)
    for g in got:  # C has too few rows of its own
        assert g.fitted == pytest.approx(fits[g.label if g.label in ("A", "B") else None][g.score])
    new = [(s / 97 * 1.4 - 0.2, x) for s in range(98) for x in ("A", "B", "C", "D", None)]
    got = calibration.isotonic(spark.createDataFrame(new, "score double, label string"), blocks).collect()
    assert len(got) == len(new)
    for g in got:
        f = fits[g.label if g.label in ("A", "B") else None]
        assert g.fitted == pytest.approx(float(np.interp(g.score, list(f), list(f.values()))))
    assert calibration.isotonic_blocks(d.limit(0)).count() == 0


def test_isotonic_pools_parts_alike(spark):
    r = np.random.default_rng(5)
    d = pd.DataFrame({"lo": np.arange(300.0), "hi": np.arange(300.0), "k": r.integers(1, 4, 300).astype(float)})
    d["s"] = (r.random(300) * d["k"] * (0.5 + d["lo"] / 600)).round(2)
    whole = calibration.pool(d)
    parts = pd.concat([calibration.pool(d[i:i + 37]) for i in range(0, 300, 37)])
    assert np.allclose(calibration.pool(parts), whole) and 1 < len(whole) < 300


def test_temperatures_by_kind(spark):
    r = np.random.default_rng(6)

    def draw(kind, n, true_t):
        z = r.normal(size=(n, 4)) * 3
        p = np.exp(z / true_t - (z / true_t).max(1, keepdims=True))
        return [(kind, row.tolist(), int(r.choice(4, p=q / q.sum()))) for row, q in zip(z, p)]

    rows = draw("cold", 400, 0.5) + draw("warm", 400, 3.0) + [("sure", [9.0, 0.0], 0)] * 5 + [("wrong", [9.0, 0.0], 1)] * 5 + [("flat", [1.0, 1.0], 0)] * 3 + [("cold", [1.0, 2.0], 7)]
    d = spark.createDataFrame(rows, "kind string, logits array<double>, target int")
    got = calibration.fit_temperatures(d, ("cold", "warm", "sure", "wrong", "flat", "none"))
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4001))
    for kind in ("cold", "warm"):
        z, y = (np.array([x[i] for x in rows if x[0] == kind and x[2] < 4]) for i in (1, 2))
        loss = [(np.log(np.exp(z / t).sum(1)) - z[np.arange(len(y)), y] / t).mean() for t in grid]
        assert got[kind] == pytest.approx(grid[int(np.argmin(loss))], rel=2e-3)
    assert got["sure"] == pytest.approx(0.05) and got["wrong"] == pytest.approx(20) and got["none"] == got["flat"] == 1


def test_selective_counts(spark):
    h = spark.createDataFrame([("c", 901, 5, 2), ("c", 301, 5, 0), ("c", 951, 0, 0), ("c", 0, 0, 4)], "cluster string, bin int, n_pii long, n_non long")
    r = leak.selective(h, 201, 501).first()
    assert (r.pii_kept, r.pii_leaked, r.pii_total) == (5, 0, 10) and (r.non_kept, r.non_over, r.non_total) == (6, 2, 6)


def test_top_k_gate(spark):
    d = spark.createDataFrame([(1, i) for i in range(1, 71)], "win int, rank int")
    kept = splits.top_k(d, 64, ["win"], [F.col("rank")])
    assert kept.where(F.col("rank").isin(1, 64, 65)).count() == 2 and kept.first().dropped == 6


def test_departures(spark):
    rows = [("a", s, 4.0 if s >= 25 else 1.0, 1.0) for s in range(0, 50, 5)] + [("b", s, 4.0 if s % 10 else 1.0, 1.0) for s in range(0, 50, 5)]
    d = spark.createDataFrame(rows, "run string, step int, loss double, base double")
    assert [(r.run, r.first) for r in series.departures(d, "run", "step", "loss", "base", 3.0, 0.25, 3).collect()] == [("a", 25)]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    e = vectors.with_unit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")).select("id", "unit")
    got = {}
    for r in vectors.nearest(e.where("id < 5").withColumnRenamed("id", "query_id"), e, 3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(5):
        s = u @ u[q]
        s[q] = -2
        assert [got[q][k] for k in (1, 2, 3)] == np.argsort(-s)[:3].tolist()


def test_nearest_in_blocks_with_ties(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(40, 6)), 3, axis=0)  # three equal rows each
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    e = spark.createDataFrame([(f"r{i:03}", v.tolist()) for i, v in enumerate(u)], "id string, unit array<double>").repartition(6)
    q = e.where("id < 'r020'").withColumnRenamed("id", "query_id")
    want = {}
    for i in range(20):
        s = np.round(u @ u[i], 12)
        want[f"r{i:03}"] = [f"r{j:03}" for j in sorted((j for j in range(120) if j != i), key=lambda j: (-s[j], j))[:5]]
    for block in (7, 1000):
        got = {}
        for r in vectors.nearest(q, e, 5, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
    assert vectors.nearest(q.limit(0), e, 5).count() == 0 and vectors.nearest(q, e.limit(0), 5).count() == 0


def test_places_read_a_text_once(spark):
    """A text is no row for each of its surfaces; places of one surface don't overlap and are whole words."""
    docs = spark.createDataFrame([(1, "foo foo foo, (foo) xfoo foo_ \U0001f600foo")], "doc_id long, text string")
    s = spark.createDataFrame([(1, "foo foo", 7), (1, "foo", 8), (1, "(foo", 9)], "doc_id long, surface string, k int")
    got = sorted((r.k, r.start, r.end, r.before) for r in detect.places(docs, s).collect())
    assert got == [(7, 0, 7, ""), (8, 0, 3, ""), (8, 4, 7, "foo "), (8, 8, 11, "foo foo "), (8, 14, 17, "o foo, ("), (8, 30, 33, "oo foo_ \U0001f600"[-8:]), (9, 13, 17, "oo foo, ")]
    assert "Generate explode" not in detect.places(docs, s)._jdf.queryExecution().executedPlan().toString()


def test_sequences_in_step_are_decoded_as_alone():
    """Sequences of many lengths in one block have the sums and the path that each has alone."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    c = crf.Chain.of(2, step=r.normal(size=(9, 9)))
    each = [r.normal(size=(n, 9)) * 3 for n in (1, 40, 7, 7, 2, 90)]
    rows = set()
    for some, e, sizes in crf._blocks(pa.array([x.tolist() for x in each] + [[]], pa.list_(pa.list_(pa.float64())))):
        a, z = c.forward_all(e, sizes)
        b, paths = c.backward_all(e, sizes), c.best_all(e, sizes)
        for j, i in enumerate(some):
            own, total = c.forward(each[i])
            n = len(each[i])
            np.testing.assert_allclose(a[:n, j], own, rtol=1e-12)
            np.testing.assert_allclose(b[:n, j], c.backward(each[i]), rtol=1e-12)
            assert abs(z[j] - total) < 1e-9 and paths[j] == c.best(each[i])
            rows.add(i)
    assert rows == set(range(6))
