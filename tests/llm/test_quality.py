import re
from collections import Counter

from spanloom.llm import quality

from .corpus import clashing, frame, texts


def metrics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {x for x, n in Counter(g).items() if n > 1}
    rep = {i + k for i, x in enumerate(g) if x in twice for k in range(3)}
    seen, dup, n = set(), 0, 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            n += 1
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), n, dup, len(rep)


def test_metrics(spark):
    rows = [*texts(), (900, "a b c d a b c x a b c\nq\nq\n\nq # $", "en", "s", 0), (901, "w " * 100, "en", "s", 0), (902, "THIS IS!! LOUD!! " * 30, "en", "s", 0)]
    got = quality.judge(clashing(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    key = lambda i, m: (str(i), *m)
    assert sorted(key(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)) for r in got) == sorted(key(r[0], metrics(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert not next(r for r in got if r.doc_id == 902).kept


def test_order_does_not_change_the_verdict(spark):
    m = quality.metrics(frame(spark))
    for order in (list(quality.RULES), list(reversed(quality.RULES))):
        assert sorted((str(r.doc_id), r.kept) for r in quality.apply(m, order).collect()) == sorted((str(r.doc_id), r.kept) for r in quality.judge(frame(spark)).collect())


def test_cascade_puts_rejections_per_cost_first():
    a, b, c = quality.RULES[:3]
    cost = {a.name: 2.0, b.name: 1.0, c.name: 0.1}
    assert quality.cascade((a, b, c), cost, [(True, False, False), (False, True, False), (False, False, False)]) == [b, a, c]
    # all that b rejects a has rejected before, so b comes after c, which is cheaper
    cost = {a.name: 1.0, b.name: 1.0, c.name: 0.5}
    assert quality.cascade((a, b, c), cost, [(True, True, False), (True, True, False), (True, False, False)]) == [a, c, b]


def test_costs_are_those_of_rules_not_of_jobs(spark):
    """A rule that reads the text by a pattern costs many times what a comparison of numbers costs."""
    cheap, dear = quality.Rule("cheap", "n_words > 1000000"), quality.Rule("dear", "length(regexp_replace(text, '(a|b|c)+[^x]', '')) < 0")
    sample = quality.metrics(frame(spark)).where("length(text) < 5000").cache()
    costs, said = quality.estimate(sample, (cheap, dear), 200)
    assert costs["dear"] > 5 * costs["cheap"] and not any(any(x) for x in said)


def test_clean_keeps_what_judge_keeps(spark):
    docs = frame(spark)
    order = list(quality.RULES)
    want = sorted(str(r.doc_id) for r in quality.judge(docs).where("kept").collect())
    for d in (docs, clashing(docs)):
        got = quality.clean(d, order)
        assert got.columns == d.columns and sorted(str(r.doc_id) for r in got.collect()) == want and want
    plan = quality.clean(docs, order[:1])._jdf.queryExecution().optimizedPlan().toString()
    assert "n_dup_lines" not in plan and "n_lines" not in plan


def test_empty(spark):
    assert quality.judge(frame(spark, [])).collect() == []
