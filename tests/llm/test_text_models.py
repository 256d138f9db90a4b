import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import langid, licenses, lm, pii, toxicity
from spanloom.session import table

from .corpus import SCHEMA, clashing, frame, texts

# toxicity ------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    lex = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, lex).join(labels, "doc_id").select("doc_id", "toxic", "score").collect()
    rest = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    caught = [r.score >= 0.3 for r in rest if r.toxic]
    wrong = [r.score >= 0.3 for r in rest if not r.toxic]
    assert sum(caught) >= 0.6 * len(caught) and sum(wrong) <= 0.03 * len(wrong)


def test_grammar_contexts():
    g = toxicity.Grammar(toxicity.Lexicon(dict.fromkeys(toxicity.INSULTS, 1.0), {"vex": 1.0}))
    s = lambda t: g.score(t)[0]
    assert s("You are an idiot.") > s("An idiot.") > s("You are not an idiot.")
    assert s("He said you are an idiot.") < s("You are an idiot.")
    assert s("I will kill you.") > 0.3 and s("I will kill time here today.") == 0
    assert s("vexing") == s("vexes") > 0.3 and s("convex") == 0
    assert s("") == s(None) == s("a plain text") == 0
    a, b, _ = g.score("Fine. You idiot! Fine.")[1][0]
    assert "Fine. You idiot! Fine."[a:b].strip() == "You idiot"


def brute_clause(g, words):
    """The sum over matches, each weighed from the words around it."""
    tags = [g.tag(w) for w in words]
    sym = [x for x, _ in tags]
    person = [x in ("target", "linked target", "you", "linked you") for x in sym]
    you = [x in ("you", "linked you") for x in sym]
    # a link verb counts at most AIM words after a target
    link = [x.startswith("linked") or x == "link" and any(person[max(0, i - toxicity.AIM - 1):i]) for i, x in enumerate(sym)]
    total = 0.0
    for i, (x, w) in enumerate(tags):
        before = slice(max(0, i - toxicity.AIM), i)
        after = slice(i + 1, i + 1 + toxicity.AIM)
        scope = (toxicity.NEGATED if "not" in sym[max(0, i - toxicity.REACH):i] else 1) * (toxicity.REPORTED if "report" in sym[:i] else 1)
        if x == "insult":
            total += w * scope * (toxicity.TARGETED if any(person[before]) else 1)
        elif x == "aimed" and (any(you[before]) or any(link[before])):
            total += w * scope * toxicity.TARGETED
        elif x == "aimed" and any(you[after]) or x == "threat" and any(person[after]):
            total += w * scope
    return total


def test_transducers_match_brute_force():
    r = random.Random(1)
    g = toxicity.Grammar(toxicity.Lexicon({"idiot": 0.9, "pig": 0.6, "trash": 0.5}, {"vex": 1.0}, frozenset({"pig", "trash"})))
    words = "idiot pig trash vexed kill burn you they them they're you're is was not never said claims fine day".split()
    for _ in range(4000):
        clause = [r.choice(words) for _ in range(r.randrange(12))]
        assert g.clause(clause) == pytest.approx(brute_clause(g, clause)), clause


def test_toxicity_query_matches_brute_force(spark, sf):
    from spanloom.llm.queries import op5_toxicity

    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    sample = [(docs[r.doc_id], r.toxic) for r in table(spark, sf, "labels").collect() if r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    g = toxicity.Grammar(toxicity.fit(sample))
    got = op5_toxicity(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        s, clauses = g.score(docs[r.doc_id])
        assert (r.score, r.predicted, r.n_clauses) == (pytest.approx(s), int(s >= 0.3), len(clauses))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_long_texts_dilute_and_offsets_are_of_the_text():
    g = toxicity.Grammar(toxicity.Lexicon({"idiot": 1.0}, {}))
    assert g.score("You idiot. " + "a fine day. " * 40_000)[0] < 0.05 < 0.3 < g.score("You idiot. " + "a fine day. " * 100)[0]
    text = "\u0130\u0130 x. You idiot"  # lower-cased, the first letters are two code points each
    a, b, _ = g.score(text)[1][0]
    assert text[a:b].strip() == "You idiot"


def test_seed_insults_need_a_target():
    g = toxicity.Grammar(toxicity.fit([]))
    s = lambda t: g.score(t)[0]
    for clean in ("The farmer sold a pig at the fair.", "Take out the trash. The clown waved. A fool and his money.", "She fed the pig and he took the trash out."):
        assert s(clean) == 0, clean
    for toxic in ("You pig!", "You are trash.", "you're such a loser", "They are scum.", "he is a complete moron", "Pathetic, all of you."):
        assert s(toxic) >= 0.3, toxic


def test_seed_insults_are_weighed_by_labels():
    rows = [("the pig ate", 0)] * 20 + [(f"you moron number {i}", 1) for i in range(2)]
    lex = toxicity.fit(rows)
    assert "pig" not in lex.words and lex.words["moron"] > toxicity.fit([]).words["moron"] == pytest.approx(0.6)
    assert toxicity.Grammar(lex).score("you pig")[0] == 0
    lex = toxicity.fit([(f"clean words {i}", 0) for i in range(90)] + [("some trash here", 1)] * 6)
    assert lex.alone("trash") and not lex.alone("pig")


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lex = toxicity.learn(frame(spark), none)
    assert lex.stems == {}
    got = toxicity.score(clashing(frame(spark)), lex).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(frame(spark, []), lex).collect() == []


# personal data -------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def samples(n=4000):
    r = random.Random(11)
    parts = ["a@b.c", "x.y@mail-1.example.com", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (202) 555-0143", "+", "@", ".", "_", "é\U0001f600", " ", "12", "\n", "d@e.f@g.h"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(n)]


def test_base_spans():
    for t in samples():
        assert [f"{k}:{s}:{e}" for s, e, k in pii.base_spans(t)] == brute_spans(t), t


def test_long_runs_are_read_once():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" * 100_000, "@" * 300_000):
        pii.base_spans(t)
        list(pii.unseen(t, pii.base_spans(t)))


def test_digest(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(samples(200))] + texts()
    got = pii.digest(pii.find(clashing(frame(spark, rows)))).collect()
    want = {}
    for i, t, *_ in rows:
        b = brute_spans(t or "")
        want.setdefault(i, set()).add((*(sum(x.startswith(k) for x in b) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) in want[r.doc_id]
        base = [x for x in r.spans.split(",") if x and not x.startswith("id:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert pii.digest(pii.find(frame(spark, []))).collect() == []


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"please write to customer mail user{i}@example.com thanks", None, None, None) for i in range(60)]
    rows += [(100, "please write to customer mail user-77-local thanks", None, None, None), (101, "built in year 199912345 or so", None, None, None)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(frame(spark, rows))).collect()}
    assert got[100] == "id:30:43" and got[101] == ""


def generations():
    """Seeds after "mail to"; ids beside them; the same ids after "ticket", where no seed is, with others; seeds after "the"."""
    rows = [f"mail to user{i}@example.com now" for i in range(8)] + [f"mail to ab-{i}-7777 now" for i in range(6)]
    rows += [f"see ticket ab-{i}-7777 please" for i in range(6)] + ["see ticket zz-99-1234 please"]
    rows += [f"the u{i}@example.com wrote" for i in range(9)] + ["the item-12345 was there"] + ["the cat and the dog saw the bird in the tree"] * 30
    rows += [f'token = "{hashlib.md5(str(i).encode()).hexdigest()[:20]}"' for i in range(9)] + ['token = "short12"']
    return [(i, t, None, None, None) for i, t in enumerate(rows)]


def test_found_items_bring_in_new_patterns(spark):
    rows = generations()
    got = {t: r.spans for (_, t, *_), r in zip(rows, sorted(pii.digest(pii.find(frame(spark, rows))).collect(), key=lambda r: r.doc_id))}
    assert got["mail to ab-0-7777 now"] == "id:8:17"
    assert got["see ticket zz-99-1234 please"] == "id:11:21"  # no seed ever stood there
    assert got["the item-12345 was there"] == ""  # a function word is no evidence, whatever seeds follow it
    assert got['token = "short12"'] == "id:9:16"


def test_pattern_scores_match_brute_force(spark):
    from collections import Counter, defaultdict

    rows = generations()
    d = pii.read(frame(spark, rows))
    seen = [(o.item, o.kind, p) for r in d.collect() for o in r.seen for p in o.patterns]
    items = defaultdict(set)
    for i, _, p in seen:
        items[p].add(i)
    wanted = {p for p in items if len(items[p]) >= pii.SEEDS}
    places = Counter()
    for _, t, *_ in rows:
        w = list(re.finditer(r"[^\W_]+", t))
        for k in range(1, len(w)):
            gap = "".join(t[w[k - 1].end():w[k].start()].split())
            for n in (1, 2, 3):
                if k >= n and len(gap) <= pii.GAP:
                    places[" ".join(x[0].lower() for x in w[k - n:k]) + gap + "_"] += 1
    known = {i: k for i, k, _ in seen if k}
    edges = Counter((p, i) for i, _, p in seen if p in wanted)
    worth = {(i, k): 1.0 for i, k in known.items()}
    for _ in range(pii.ROUNDS):
        conf = {}
        for p in wanted:
            for k in set(known.values()):
                of = [(n * worth[i, k], worth[i, k]) for (q, i), n in edges.items() if q == p and (i, k) in worth]
                if of:
                    c = min(1.0, sum(x for x, _ in of) / (places[p] + 1))
                    conf[p, k] = (c, sum(w >= pii.PROMOTED for _, w in of))
        trusted = {x: c for x, (c, n) in conf.items() if c >= pii.CONFIDENCE and n >= pii.SEEDS}
        worth = {(i, k): 1.0 for i, k in known.items()}
        for (p, i) in edges:
            for (q, k), c in trusted.items():
                if p == q and i not in known:
                    worth[i, k] = 1 - (1 - worth.get((i, k), 0.0)) * (1 - min(c, 0.999))
    table = spark.createDataFrame([(p,) for p in wanted], "pattern string")
    got = pii.background(frame(spark, rows), table)
    # a filter that lets nearly everything through changes nothing
    assert sorted(map(tuple, pii.background(frame(spark, rows), table, 64).collect())) == sorted(map(tuple, got.collect()))
    assert {r.pattern: r.places for r in got.collect()} == {p: places[p] for p in wanted}
    flat = spark.createDataFrame([x for x in seen if x[2] in wanted], "item long, kind string, pattern string")
    scored = {(r.pattern, r.kind): (r.confidence, r.supporters, r.trusted) for r in pii.score_patterns(flat, got).collect()}
    assert scored.keys() == conf.keys()
    for x, (c, n) in conf.items():
        assert scored[x] == (pytest.approx(c), n, x in trusted), x


# licenses ------------------------------------------------------------------------------------------------------------


def test_license_spans(spark):
    mit = licenses.TEMPLATES["mit"][1]
    notice = "Released under the MIT License."
    changed = mit.replace("publish, distribute, ", "").replace("furnished", "given")
    rows = [(1, f"Some words.\n{notice}\nMore words.", 0, 0, 0), (2, f"x y z {mit} the end", 0, 0, 0), (3, f"intro\n{changed}", 0, 0, 0), (4, "the rights to use this text are nowhere", 0, 0, 0), (5, None, 0, 0, 0), (6, "", 0, 0, 0), (7, f"{notice} {notice}", 0, 0, 0)]
    rows = [(i, t, None, None, None) for i, t, *_ in rows]
    got = licenses.scan(clashing(frame(spark, rows))).collect()
    text = dict((r[0], r[1]) for r in rows)
    assert sorted((r.doc_id, r.template) for r in got) == [(1, "mit-notice"), (2, "mit"), (3, "mit"), (7, "mit-notice"), (7, "mit-notice")]
    for r in got:
        span = text[r.doc_id][r.start:r.end]
        assert span.startswith(("Released", "Permission")) and span.endswith(("License", "Software"))
        assert (r.coverage == 1) == (r.doc_id != 3) and r.coverage >= 0.9
    assert licenses.scan(frame(spark, [])).collect() == []


def test_license_edges(spark):
    rows = texts()
    notice = "Released under the MIT License."
    rows += [(400, f"{rows[0][1]}\n{notice}", None, None, None)] * 2 + [(401, " ".join(["word"] * 30_000) + f" {notice}", None, None, None)]
    got = sorted((r.doc_id, r.template) for r in licenses.scan(clashing(frame(spark, rows))).collect())
    assert got == [(400, "mit-notice")] * 2 + [(401, "mit-notice")]


def test_many_notices_take_linear_time():
    import time

    index = licenses.Index(licenses.templates())
    notice = "Licensed under the Apache License, Version 2.0. "

    def seconds(n):
        t = time.perf_counter()
        assert len(index.scan(notice * n)) == n
        return time.perf_counter() - t

    seconds(10)
    assert seconds(1600) < 24 * seconds(200)


def test_full_texts_and_siblings():
    index = licenses.Index(licenses.templates())
    for k, (name, text) in licenses.templates().items():
        got = index.scan(f"before it\n{text}\nafter it")
        best = max(got, key=lambda x: x[4])
        assert best[1] == 1 and licenses.templates()[best[0]][0] == name, k
    words = licenses.templates()["gpl-3.0-text"][1].split(" ")
    edited = " ".join(w for i, w in enumerate(words) if i % 25)  # each 25th word is gone
    assert [x[0] for x in index.scan(edited) if x[5] > 2000] == ["gpl-3.0-text"]
    assert [x[0] for x in index.scan(licenses.TEMPLATES["lgpl-2.1"][1])] == ["lgpl-2.1"]
    assert [x[0] for x in index.scan(licenses.TEMPLATES["bsd-2-clause"][1])] == ["bsd-2-clause"]


def matched(template, words):
    """Most words of the template in order within words."""
    p = [0] * (len(words) + 1)
    for t in template:
        q = [0]
        for j, w in enumerate(words):
            q.append(max(p[j] + (t == w), p[j + 1], q[-1]))
        p = q
    return p[-1]


def test_license_query_matches_brute_force(spark, sf):
    """Word for word copies of every template are found, and what is found is as well covered as is said."""
    from spanloom.llm.queries import op2_license_scan

    sf = sf.replace("0.001", "0.01")
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    known = {k: licenses.tokens(t)[0] for k, (_, t) in licenses.templates().items()}
    got = op2_license_scan(spark, sf).collect()
    places = {}
    for r in got:
        places.setdefault(r.doc_id, []).append((r.start, r.end))
        span = licenses.tokens(docs[r.doc_id][r.start:r.end])[0]
        assert r.n_template == len(known[r.template]) and r.n_matched <= matched(known[r.template], span)
        assert r.coverage == r.n_matched / r.n_template >= licenses.COVERAGE and r.license == licenses.templates()[r.template][0]
    exact = 0
    for i, t in docs.items():
        words, where = licenses.tokens(t or "")
        line = f" {' '.join(words)} "
        for k, w in known.items():
            needle, at = f" {' '.join(w)} ", -1
            while (at := line.find(needle, at + 1)) >= 0:
                exact += 1
                n = line[:at].count(" ")
                s, e = where[n][0], where[n + len(w) - 1][1]
                assert any(a < e and s < b for a, b in places.get(i, ())), (i, k)
    assert exact and len(got) >= exact


# language model ------------------------------------------------------------------------------------------------------


def toks(t):
    return [x.decode() for x in (t or "").encode().lower().split()] + [""]


@pytest.mark.parametrize("contexts", [1 << 17, 40, 0])
def test_lm_counts(spark, contexts):
    rows = texts()
    docs = clashing(frame(spark, rows)).where("doc_id is not null or true")
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    from pyspark.sql import functions as F

    got = lm.score(docs, docs.where(~lm.held_out(F.col("doc_id"))), contexts).collect()
    c = {}
    for r in train:
        for w in toks(r[1]):
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(toks(r[1])), sum(w in c for w in toks(r[1])), n, round(sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in toks(r[1])), 4)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_does_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 1 << 12)  # several blocks, with heavy words in them
    monkeypatch.setattr(lm, "HEAVY", 50)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = []
    for n in (4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        d = docs.repartition(n, "doc_id")
        got.append({r.doc_id: r.score for r in lm.score(d, d.where(~lm.held_out(F.col("doc_id"))), 300).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert all(got[0][k] == pytest.approx(got[1][k], rel=1e-9) for k in got[0])


def test_lm_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 1 << 10)
    monkeypatch.setattr(lm, "HEAVY", 50)
    docs = frame(spark, [r for r in texts() if r[1] and len(r[1]) < 2000])
    model = lm.fit(docs, 40)
    v = model.vocabulary
    held = {}
    for d in (model.pairs, model.seats):
        for r in d.collect():
            held.setdefault(r.block, {})[r.kind] = r.blob
    assert len(held) > 2 and len(v.heavy)
    total = np.zeros(v.none + 1)
    # a heavy word is spread over blocks, each of which has its pairs with some contexts: own parts add up, the root counts once
    seen = set()
    for kinds in held.values():
        x = lm.Scorer(v, model.kept, [bytes(kinds[lm.PAIRS])], [bytes(kinds[lm.SEATS])])
        total += np.bincount(x.key % (v.none + 1), x.own, v.none + 1)
        new = np.array([w not in seen for w in x.word.tolist()])
        seen |= set(x.word.tolist())
        total += (x.back * x.root[:, :-1][:, new].sum(axis=1)[:, None]).mean(axis=0)
    total += (x.back * x.root[:, -1:]).mean(axis=0)
    used = np.append(model.kept[0].customers > 0, True)
    assert len(seen) == v.words and np.allclose(total[used], 1, atol=1e-9)


def test_every_context_has_its_restaurant(spark, sf, monkeypatch):
    """Contexts whose totals no worker holds score as those that all workers hold, in several blocks and with heavy words."""
    monkeypatch.setattr(lm, "BLOCK", 1 << 12)
    monkeypatch.setattr(lm, "HEAVY", 50)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    train = docs.where(~lm.held_out(F.col("doc_id")))
    want, got = ({r.doc_id: (r.base_score, r.score) for r in lm.score(docs, train, n).collect()} for n in (1 << 17, 30))
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want) and len(got) == len(want)


def test_probabilities_after_rare_contexts_sum_to_one(spark):
    docs = frame(spark, [r for r in texts() if r[1] and len(r[1]) < 2000])
    model = lm.fit(docs, 0)
    v, held = model.vocabulary, {}
    for d in (model.pairs, model.seats, model.contexts):
        for r in d.collect():
            held.setdefault(r.kind, []).append(bytes(r.blob))
    assert v.blocks == 1 and len(v.context) == 0
    x = lm.Scorer(v, model.kept, held[lm.PAIRS], held[lm.SEATS])
    rare, customers, pairs = lm.decode(held[lm.CONTEXT_TOTALS][0])
    tables = np.tile(pairs, (len(model.kept), 1))
    for blob in held[lm.PARTS]:
        _, names, _, *more = lm.decode(blob)
        tables[:, np.searchsorted(rare, names)] += np.stack(more)
    assert len(rare) == v.words - 1  # all words but the end
    n = len(x.word) + 1
    for i in range(0, len(rare), 50):
        assert x.far_probability(np.arange(n), np.full(n, i), rare, customers, tables).sum() == pytest.approx(1, abs=1e-9)


def test_seats_follow_the_posterior():
    """Four customers of one dish in a restaurant: the number of tables, against the sum over all seatings."""
    from itertools import product

    d, mass = 0.4, 0.7
    want = np.zeros(5)
    for seating in product(range(4), repeat=4):  # table of each customer, tables numbered as they open
        if any(x > max(seating[:i], default=-1) + 1 for i, x in enumerate(seating)):
            continue
        p, sizes = 1.0, []
        for x in seating:
            if x == len(sizes):
                p, sizes = p * mass, [*sizes, 1]
            else:
                p *= sizes[x] - d
                sizes[x] += 1
        want[len(sizes)] += p
    n = 20_000
    s, r = lm.Seats(np.ones(n, int), np.full(n, 4), np.full(n, 1)), np.random.default_rng(0)
    idx = np.arange(n)
    for _ in range(60):
        s.remove(idx, r)
        s.add(idx, np.full(n, mass), d, r)
    assert (s.c == 4).all() and len(s.sizes) == s.t.sum() and s.sizes.sum() == 4 * n
    assert np.allclose(np.bincount(s.t, minlength=5) / n, want / want.sum(), atol=0.015)


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_word_hashes(monkeypatch, piece):
    import pyarrow as pa

    monkeypatch.setattr(lm, "PIECE", piece)
    rows = [t for _, t, *_ in texts() if t is None or len(t) < 60_000] + ["a" * 100 + " b", " \t ", "x  y\n" * 50, " " * 200 + "q"]
    h, text = lm.batch_tokens(pa.array(rows), lm.Hasher(0))
    said = [(i, w) for i, t in enumerate(rows) for w in toks(t)]
    assert text.tolist() == [i for i, _ in said]
    by = {}
    for (_, w), x in zip(said, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_words_that_share_a_hash_go_by_the_second(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(["aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp qq rr ss tt", "aa bb aa", "zz aa"])]
    docs = frame(spark, rows)
    v = lm.vocabulary(docs)
    assert len(v.shared) == 0 and v.words == 22
    import pyarrow as pa

    w, _, _ = lm.Vocabulary(1, 1, np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, int), np.unique(lm.batch_tokens(pa.array(["aa"]), lm.Hasher(0))[0][:1])).tokens_of(pa.array(["aa bb"]), (lm.Hasher(0), lm.Hasher(1)))
    assert w[0] == lm.batch_tokens(pa.array(["aa"]), lm.Hasher(1))[0][0] and w[1] == lm.batch_tokens(pa.array(["bb"]), lm.Hasher(0))[0][0]


def test_lm_beats_unigrams_on_held_out(spark, sf):
    from spanloom.llm.queries import op6_lm_scoring

    rows = [r for r in op6_lm_scoring(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_empty(spark):
    assert lm.score(frame(spark, []), frame(spark, [])).collect() == []
    got = lm.score(frame(spark, [(1, "a b", None, None, None)]), frame(spark, [])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]


# language ------------------------------------------------------------------------------------------------------------


def test_languages(spark, sf):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    got = langid.identify(docs, pages)
    both = got.where("doc_id is not null").join(docs.selectExpr("doc_id", "lang as truth"), "doc_id").collect()
    assert len(both) == docs.count() and sum(r.lang == r.truth for r in both) >= 0.97 * len(both)
    web = got.where("page_id is not null").join(pages, "page_id").collect()
    right = [r.lang == m[1] for r in web if (m := re.search(r"/(en|de|fr|es)/", r.url))]
    assert len(web) == pages.count() and sum(right) >= 0.97 * len(right)


def test_evidence_without_text(spark):
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 20)], SCHEMA)
    pages = [(i, f"http://a{i % 3}.seite.de/x", "<html lang=de><p>das haus und der garten das haus</p>") for i in range(30)]
    pages += [(90, "http://a1.seite.de/y", "<html><script>the house and the garden</script></html>"), (91, None, None), (92, "not an address", "<html lang='de'></html>"), (93, "http://x.y.uk", "the house and the garden")]
    web = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(docs, clashing(web)).where("page_id is not null").collect()}
    assert len(got) == 34
    assert got[90].lang == "de" and got[90].text_lang is None and got[92].lang == "de" and got[93].lang == "en"
    assert got[91].lang in ("de", "en")


@pytest.mark.parametrize("before", ["<!-- " + "x" * 10_000 + " -->", "<script>" + "x < 1; " * 2_000 + "</script>", "<meta name=a content=b>" * 500, "<!-- <html lang=fr> -->"])
@pytest.mark.parametrize("tag", ["<html lang=de>", "<meta http-equiv='content-language' content='de'>"])
def test_declaration_anywhere_in_a_page(spark, before, tag):
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate([("the house", "en"), ("das haus", "de")] * 5)], SCHEMA)
    web = spark.createDataFrame([(1, "http://a.b.de/x", f"{before}{tag}<p>das haus</p>")], "page_id long, url string, html string")
    got = langid.identify(docs, web).where("page_id is not null").first()
    assert (got.declared, got.n_words) == ("de", 2)


def test_shuffled_lookups_give_the_same(spark, sf, monkeypatch):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    model = langid.learn(docs)
    monkeypatch.setattr(langid, "HOT_SHARE", 20)
    a, b = (sorted(((r.doc_id or -1, r.page_id or -1, r.lang, round(r.probability, 9)) for r in langid.identify(docs, pages, model, n).collect())) for n in (10**6, 0))
    assert a == b


def brute_languages(spark, sf):
    """Every row's posterior, from the definitions, one row at a time."""
    import numpy as np
    from collections import defaultdict
    from urllib.parse import urlsplit

    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    model = langid.learn(docs)
    rows = []
    for r in docs.collect():
        rows.append((("d", r.doc_id), r.text or "", None, r.source, None, None))
    for r in pages.collect():
        tags = langid.shown(r.html or "")
        host = urlsplit(r.url).hostname
        rows.append((("p", r.page_id), langid.page_text(tags), langid.declared(tags), host, ".".join(host.split(".")[-2:]), host.split(".")[-1]))
    n = len(model.langs)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    lls = [sum((model.word(w) for w in langid.WORD.findall(t.lower())), np.zeros(n)) * langid.TEMPER for _, t, *_ in rows]
    ps = [soft(x) for x in lls]
    total = sum(ps) + 1.0
    by = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    for p, (_, _, *keys) in zip(ps, rows):
        for k, table_ in zip(keys, by):
            table_[k] += p
    out = {}
    for ll, p, (key, _, said, host, domain, suffix) in zip(lls, ps, rows):
        prior = total / total.sum()
        for k, table_ in ((domain, by[2]), (host, by[1])):
            c = np.maximum((table_[k] if k is not None else 0) - (p if host is not None else 0), 0)
            prior = (c + langid.HOST_PRIOR * prior) / (c.sum() + langid.HOST_PRIOR)
        logs = ll + np.log(prior)
        for k, table_ in ((said, by[0]), (suffix, by[3])):
            if k is not None:
                logs = logs + np.log((table_[k] + langid.TABLE_PRIOR * total / total.sum()) / total)
        q = soft(logs)
        out[key] = (model.langs[int(q.argmax())], float(q.max()))
    return out


def test_language_query_matches_brute_force(spark, sf):
    from spanloom.llm.queries import op10_language_id

    want = brute_languages(spark, sf)
    got = {("d", r.doc_id) if r.doc_id is not None else ("p", r.page_id): (r.lang, r.probability) for r in op10_language_id(spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, (lang, p) in want.items():
        assert got[k] == (lang, pytest.approx(p, rel=1e-6)), k


def test_pages_full_of_brackets_take_linear_time():
    import time

    def seconds(n):
        t = time.perf_counter()
        for page in ("<" * n, "<a " * n, "<meta " * n, "<html x" * n, "<html " + "a" * n, "<html " + "a =" * n):
            tags = langid.shown(page)
            langid.page_text(tags)
            langid.declared(tags)
        return time.perf_counter() - t

    assert seconds(200_000) < 60 * max(seconds(10_000), 0.005)


def test_meta_attributes_in_any_order():
    assert langid.declared("<meta content='fr' http-equiv='Content-Language'>") == "fr"
    assert langid.declared("<meta http-equiv=content-language content=\"de-AT, en\"><html data-x=lang lang='es'>") == "es"
    assert langid.declared("<meta name='description' content='de'><html>") is None


def test_language_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    got = langid.identify(clashing(frame(spark)), none).collect()
    assert len(got) == len(texts())
    assert langid.identify(frame(spark, []), none).collect() == []
    got = langid.identify(frame(spark, [(1, "text", None, None, 0)]), none).collect()
    assert [r.lang for r in got] == [None]
