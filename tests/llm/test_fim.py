import hashlib
import re

from pyspark.sql import functions as F

from spanloom.llm import fim

from .corpus import clashing, frame, texts


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text, seed=7, rate=100, spm=50):
    """The contract, by the pattern as it is written there."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    (900, "one line", None, None, 0), (901, "\n", None, None, 0), (902, "\n\n\na\n", None, None, 0), (903, "a\r\nb c\x0bd\n\U0001f600é\n", None, None, 0), (904, "holds <P> here\nb\n", None, None, 0),
    (905, "holds <M> here", None, None, 0), (906, "<S>", None, None, 0), (907, "almost <P\n<S\n<M\n>x<\n" * 9, None, None, 0), (-5, "a\nb\nc\n" * 50, None, None, 0), (2**62, "a\nb\nc", None, None, 0), (908, "y" * 300_000 + "\nz", None, None, 0),
]


def test_matches_brute_force_and_restores(spark):
    rows = [*texts(), *ODD]
    got = fim.transform(clashing(frame(spark, rows))).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr(brute(r[0], r[1])) for r in rows)
    assert sorted(r.back for r in got) == sorted(r[1] or "" for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rate_and_share_of_forms(spark):
    rows = [(i, "a\nb\nc\nd", None, None, 0) for i in range(400)]
    got = fim.transform(frame(spark, rows), fim.Plan(seed=3, rate=60, spm=25)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(r[0], r[1], 3, 60, 25)) for r in rows)
    forms = [r.form for r in got]
    assert 120 < forms.count("plain") < 200 and forms.count("spm") < forms.count("psm")


def test_digest(spark):
    got = {r.doc_id: r for r in fim.digest(fim.transform(frame(spark, ODD))).collect()}
    for i, t, *_ in ODD:
        assert got[i].output_sha256 == sha(brute(i, t)[5]) and got[i].restored_sha256 == sha(t)
        assert (got[i].prefix_chars is None) == (got[i].middle_chars is None) == (got[i].form == "plain")


def test_empty(spark):
    assert fim.digest(fim.transform(frame(spark, []))).collect() == []
