import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import prob, text
from spanloom.operators import detect


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


def test_word_runs_are_code_points(spark):
    t = "😀 Zoë_x ²½ 漢字!a"
    got = text.word_runs(spark.createDataFrame([(1, t), (2, ""), (3, "---")], "doc_id long, text string")).orderBy("idx").collect()
    want = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", t)]
    assert [(r.start, r.end, r.word) for r in got] == want and [r.idx for r in got] == list(range(len(want)))


def test_matches_equal_python_offsets(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab 12é😀-") for _ in range(60))) for i in range(80)]
    got = {(x.doc_id, x.start, x.end, x.surface) for x in text.matches(spark.createDataFrame(rows, "doc_id long, text string"), "[0-9]+-?").collect()}
    assert got == {(i, *m.span(), m[0]) for i, t in rows for m in re.finditer("[0-9]+-?", t)}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_check_digits(spark):
    r = random.Random(2)
    cards = ["".join(r.choice("0123456789") for _ in range(r.randrange(1, 20))) for _ in range(300)] + ["4111111111111111"]
    got = spark.createDataFrame([(c,) for c in cards], "c string").select("c", text.luhn_ok(F.col("c")).alias("ok"), text.aba_ok(F.col("c")).alias("aba")).collect()
    assert all(x.ok == luhn(x.c) for x in got)
    assert all(x.aba == (len(x.c) == 9 and sum(int(c) * w for c, w in zip(x.c, [3, 7, 1] * 3)) % 10 == 0) for x in got)
    ibans = [("DE89 3704 0044 0532 0130 00", True), ("DE89370400440532013001", False), ("GB82WEST12345698765432", True), ("DE89", False)]
    got = spark.createDataFrame(ibans, "c string, want boolean").select("want", text.iban_ok(F.col("c")).alias("ok")).collect()
    assert all(x.ok == x.want for x in got)


def test_validators_equal_python(spark):
    r = random.Random(3)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "078-05-1120", "000-12-3456", "a.b@c.de", "021000021", "routing no ", "DE89370400440532013000", " ", "x", "12", "\n", "(202) 555-0143"]
    rows = [(i, "".join(r.choice(bits) for _ in range(8))) for i in range(200)]
    card = re.compile(r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)")
    want = {(i, *m.span()) for i, t in rows for m in card.finditer(t) if 13 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = detect.validator_spans(docs).collect()
    assert {(x.doc_id, x.start, x.end) for x in got if x.raw == "card"} == want and want
    text_of = dict(rows)
    assert all(text_of[x.doc_id][x.start:x.end] == x.surface for x in got)
    aba = re.compile(r"(?<!\d)\d{9}(?!\d)")
    want = {(i, *m.span()) for i, t in rows for m in aba.finditer(t) if sum(int(c) * w for c, w in zip(m[0], [3, 7, 1] * 3)) % 10 == 0 and re.search("routing|aba|transit", t[max(0, m.start() - 40):m.start()], re.I)}
    assert {(x.doc_id, x.start, x.end) for x in got if x.raw == "aba"} == want


def shingles(t, n=5):
    w = re.findall(r"\w+", t.lower())
    return ({" ".join(w)} if w else set()) if len(w) < n else {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("t", ["", "!!", "one Two", "a b c d e", "a b c d e a b c d e f", "x_y z-w 1 2 3 4"])
def test_shingles(spark, t):
    assert set(one(spark, "t string", (t,), text.shingles(F.col("t")).alias("s")).s) == shingles(t)


def test_jaccard(spark):
    j = lambda a, b: one(spark, "a array<string>, b array<string>", (a, b), text.jaccard(F.col("a"), F.col("b")).alias("j")).j
    assert j([], []) == 1 and j(["x"], []) == 0 and j(["x", "y"], ["y", "z"]) == pytest.approx(1 / 3)


def test_skeleton(spark):
    t = "Dear Ada  Byron,\nyour card 4111 is  ok."
    spans = [(5, 15, "PERSON"), (5, 8, "PERSON"), (27, 31, "ACCOUNT_NUMBER")]
    got = one(spark, "t string, s array<struct<start:int,end:int,label:string>>", (t, spans), text.skeleton(F.col("t"), F.col("s")).alias("k")).k
    assert got == "dear <person>, your card <account_number> is ok."
    assert one(spark, "t string, s array<struct<start:int,end:int,label:string>>", ("Call 555", None), text.skeleton(F.col("t"), F.col("s")).alias("k")).k == "call 000"


def nearest(t, start, end, s, w=8):
    if s is None or t[start:end] == s:
        return start, end
    lo, hi = max(0, start - w), min(len(t), end + w)
    at = [i for i in range(lo, hi - len(s) + 1) if t[i:i + len(s)] == s]
    if at and s:
        i = min(at, key=lambda i: (abs(i - start), i))
        return i, i + len(s)
    return nearest(t, start, end, s.strip(" "), w) if s.strip(" ") not in ("", s) else None


def test_reanchor(spark):
    r = random.Random(4)
    rows = []
    for _ in range(300):
        t = "".join(r.choice("ab é") for _ in range(40))
        a = r.randrange(30)
        b = a + r.randrange(1, 6)
        k = r.randrange(-6, 7)
        rows.append((t, max(0, a + k), max(0, a + k) + b - a, r.choice([t[a:b], " " + t[a:b], "zz", None])))
    got = spark.createDataFrame(rows, "t string, s int, e int, x string").select("*", text.reanchor(F.col("t"), F.col("s"), F.col("e"), F.col("x")).alias("r")).collect()
    for g in got:
        assert (tuple(g.r) if g.r else None) == nearest(g.t, g.s, g.e, g.x), g


def test_reanchor_reads_a_neighbourhood(spark, sf):
    """Spans meet their text in one row; a text was carried and walked from its beginning for each of them."""
    from spanloom.plans import catalog

    t = "\U0001d5d4b é ab" * 40
    rows = [(1, i, a, a + 3, max(0, a + k), max(0, a + k) + 3) for i, (a, k) in enumerate((a, k) for a in (0, 1, 9, 100, 268) for k in (-4, -1, 0, 2, 4))]
    docs = spark.createDataFrame([(1, t), (2, "no spans"), (3, None)], "doc_id long, text string")
    g = spark.createDataFrame([*rows, (3, 0, 0, 1, 0, 1)], "doc_id long, idx int, start int, end int, s int, e int")
    near = text.neighbourhoods(docs, g, 8)
    fixed = text.reanchor(F.col("near"), F.col("s") - F.col("at"), F.col("e") - F.col("at"), F.col("surface"))
    got = {(r.doc_id, r.idx): (r.surface, r.at + r.f.start if r.f else None) for r in near.select("*", fixed.alias("f")).collect()}
    for doc, i, a, b, s, e in rows:
        want = nearest(t, s, e, t[a:b])
        assert got[doc, i] == (t[a:b], want[0] if want else None)
    assert len(got) == len(rows) + 1 and got[3, 0][0] is None
    plan = catalog.QUERIES["reanchored"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "substring(text" not in plan and "SortMergeJoin" not in plan


def test_small_text_functions(spark):
    r = one(spark, "t string", ("  Straße ",), text.surface_key(F.col("t")).alias("k"), text.trimmed(F.col("t"), F.lit(0), F.length("t")).alias("b"), text.spell(F.lit("40 7")).alias("s"), text.raw_label(F.lit(" First_Name ")).alias("l"),
            text.label_text(F.lit("first_name"), F.lit("given name")).alias("d"), text.mentions(F.lit("my card is"), F.lit("card number")).alias("m"), text.length_bucket(F.lit(1000)).alias("n"), text.fits(F.lit("a b-c d"), F.lit("x"), F.lit(2), 7).alias("f"))
    assert (r.k, tuple(r.b), r.s, r.l, r.d, r.m, r.n, r.f) == ("strasse", (2, 8), "four zero seven", "first name", "first name: given name", True, "1k-10k", True)


def test_bins_and_thresholds(spark):
    assert [prob.k_of(t) for t in (0, 0.5, 0.5001, 1, 1.001, 2)] == [0, 500, 501, 1000, 1001, 1001]
    got = spark.createDataFrame([(x,) for x in (None, -1.0, 0.0, 0.5, 0.999, 1.0, 0.29)], "s double").select(prob.bin_of(F.col("s")).alias("b"), prob.k_of_column(F.coalesce("s", F.lit(0.0))).alias("k")).collect()
    assert [r.b for r in got] == [0, 0, 1, 501, 1000, 1001, 291]
    assert [r.k for r in got] == [0, 0, 0, 500, 999, 1000, 290]


def test_probability_vectors(spark):
    d = spark.createDataFrame([([1.0, 3.0, 0.0],)], "p array<double>")
    r = d.select(prob.normalised(F.col("p")).alias("n"), prob.argmax(F.col("p")).alias("a"), prob.confidence(prob.normalised(F.col("p"))).alias("c"), prob.retempered(F.col("p"), 0.5).alias("t"),
                 prob.fault_of(F.col("p"), F.lit(2)).alias("f"), prob.failed_answer(F.lit(3), F.lit(1)).alias("w"), prob.iou(F.lit(0), F.lit(4), F.lit(2), F.lit(6)).alias("i")).first()
    assert r.n == [0.25, 0.75, 0.0] and r.a == 1 and r.f == "length" and r.w == [0.5, 0.0, 0.5]
    assert r.c == pytest.approx(1 + (0.25 * math.log(0.25) + 0.75 * math.log(0.75)) / math.log(3))
    assert r.t == pytest.approx([0.1, 0.9, 0.0]) and r.i == pytest.approx(1 / 3)


def test_places_are_added_up_inside_the_row(spark, tmp_path):
    """No sort and no window over the words of all texts, which spilled; rows of one id stay apart."""
    from spanloom.operators import windows

    at = str(tmp_path / "texts")
    spark.createDataFrame([(1, "ab, cd"), (1, " ef"), (2, None)], "doc_id long, text string").write.parquet(at)
    d = spark.read.parquet(at)
    for made in (text.word_runs(d), text.matches(d, "[a-z]+"), windows.text_windows(d, 2, 1)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan
    assert sorted((r.start, r.end, r.word, r.next_end) for r in text.word_runs(d).collect()) == [(0, 2, "ab", 6), (1, 3, "ef", None), (4, 6, "cd", None)]
