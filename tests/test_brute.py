"""Registered queries without SQL, over whole tables, against independent computations in plain Python."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pytest

from spanloom.operators import crf
from spanloom.plans import catalog, demo


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in demo.documents(spark, sf).collect()}


def word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def test_propagated(spark, sf, texts):
    """A copy stands at a whole-word place of a confident surface that nothing better covers, and every such place is covered."""
    given, made = {}, {}
    for r in catalog.QUERIES["propagated"](spark, sf).collect():
        (made if r.propagated else given).setdefault(r.doc_id, []).append((r.start, r.end, r.label, r.score))
    n = 0
    for doc, spans in given.items():
        text, copies = texts[doc], made.get(doc, [])
        allowed = {}
        for s, e, label, score in spans:
            surface = text[s:e]
            if score < 0.5 or sum(unicodedata.category(c)[0] in "LN" for c in surface) < 4 or label == "PERSON" and not surface[:1].isupper():
                continue
            at = text.find(surface)
            while at >= 0:
                end = at + len(surface)
                whole = not (at and word(text[at - 1])) and not (end < len(text) and word(text[end]))
                title = re.search(r"(?i)(?<![^\W_])(mr|mrs|ms|miss|dr|prof|sir|madam)\.?\s+$", text[max(0, at - 8):at])
                if whole and (label != "PERSON" or " " in surface.strip() or title):
                    allowed.setdefault((at, end), set()).add((label, score))
                at = text.find(surface, at + 1)
        taken = [x[:2] for x in spans + copies]
        for s, e, label, score in copies:
            n += 1
            assert (label, score) in allowed[s, e] and score == max(x for _, x in allowed[s, e])
            assert sum(s < b and e > a for a, b in taken) == 1  # itself
        for s, e in allowed:
            assert any(s < b and e > a for a, b in taken), (doc, s, e)
    assert n > 20


def test_crf_path(spark, sf):
    """Over whole texts: no path of one changed tag, nor of one changed pair, scores more, and a plain Viterbi agrees."""
    chain = crf.Chain.of(2)
    emissions = {r.doc_id: np.array(r.emissions) for r in catalog._emissions(spark, sf).collect()}
    got = {r.doc_id: [int(x) for x in r.path.split()] for r in catalog.QUERIES["crf_path"](spark, sf).collect()}
    assert got.keys() == emissions.keys()

    def total(e, path):
        return chain.start[path[0]] + chain.end[path[-1]] + sum(e[i][t] for i, t in enumerate(path)) + sum(chain.step[a][b] for a, b in zip(path, path[1:]))

    for doc, e in emissions.items():
        best = np.array(chain.start) + e[0]
        for x in e[1:]:
            best = (best[:, None] + np.array(chain.step)).max(axis=0) + x
        assert len(got[doc]) == len(e) and total(e, got[doc]) == pytest.approx((best + np.array(chain.end)).max())


def test_crf_spans(spark, sf):
    """Over whole texts: segments of short documents by all tag paths, and those of any by running sums of the chain."""
    chain = crf.Chain.of(2, step=np.zeros((9, 9)))
    emissions = {r.doc_id: np.array(r.emissions) for r in catalog._emissions(spark, sf).collect()}
    got = {}
    for r in catalog.QUERIES["crf_spans"](spark, sf).collect():
        got.setdefault(r.doc_id, {})[r.first, r.last, r.type] = r.probability
    assert max(last for x in got.values() for _, last, _ in x) > 100
    for doc, e in emissions.items():
        for (first, last, t), p in list(got.get(doc, {}).items())[:3]:
            # the chain forced through the segment's tags, over the whole chain
            begin, inside, end, single = range(1 + 4 * t, 5 + 4 * t)
            ok = np.ones(e.shape, bool)
            tags = [single] if first == last else [begin, *[inside] * (last - first - 1), end]
            for i, tag in zip(range(first, last + 1), tags):
                ok[i] = np.arange(e.shape[1]) == tag
            assert p == pytest.approx(np.exp(-chain.loss(e, ok)), rel=1e-6) and p >= 0.05


def test_validator_spans(spark, sf, texts):
    """Every match of each detector's pattern that passes its check, by Python's own matcher."""
    import regex

    from spanloom.operators.detect import LABELS, PATTERNS

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def iban(s):
        s = s.replace(" ", "")
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    want = []
    for doc, t in texts.items():
        for kind, pattern in PATTERNS.items():
            for m in regex.finditer(pattern, t):
                digits = "".join(c for c in m[0] if c in "0123456789")
                if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "iban" and not iban(m[0]):
                    continue
                if kind == "aba" and not (sum(int(c) * w for c, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0 and re.search("routing|aba|transit", t[max(0, m.start() - 40):m.start()].lower())):
                    continue
                want.append((doc, m.start(), m.end(), LABELS[kind], kind, m[0]))
    got = [(r.doc_id, r.start, r.end, r.label, r.raw, r.surface) for r in catalog.QUERIES["validator_spans"](spark, sf).collect()]
    # telephone numbers have no pattern of their own; test_numbering.py and SQL hold them
    assert sorted(g for g in got if g[4] != "phone") == sorted(want) and want


def test_redaction_share(spark, sf, texts):
    """Letters and numbers in word runs that an e-mail or card touches."""
    hidden = {}
    for r in catalog.QUERIES["validator_spans"](spark, sf).where("raw in ('email', 'card')").collect():
        hidden.setdefault(r.doc_id, []).append((r.start, r.end))
    docs = {r.doc_id: (r.lang, r.source) for r in demo.documents(spark, sf).collect()}
    want = {}
    for doc, t in texts.items():
        runs, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and unicodedata.category(t[j])[0] in "LN":
                j += 1
            if j > i:
                runs.append((i, j))
            i = max(j, i + 1)
        if not runs:
            continue
        x = want.setdefault(docs[doc], [0, 0, 0])
        x[0] += 1
        x[1] += sum(b - a for a, b in runs)
        x[2] += sum(b - a for a, b in runs if any(a < e and b > s for s, e in hidden.get(doc, ())))
    got = {(r.lang, r.source): (r.docs, r.alnum, r.hidden, r.share) for r in catalog.QUERIES["redaction_share"](spark, sf).collect()}
    assert got == {k: (n, a, h, pytest.approx(h / a, abs=1e-6)) for k, (n, a, h) in want.items()}
