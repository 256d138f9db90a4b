import random
import re

from spanloom.llm import decontaminate

from .corpus import SCHEMA, clashing, prose, texts


def sh(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute(rows, items):
    out = []
    for k, t in items:
        n = min(5, len((t or "").split()))
        if k is None or not n:
            continue
        q = sh(t, n)
        for i in {r[0] for r in rows if r[0] is not None}:
            c = max(len(q & sh(r[1], n)) for r in rows if r[0] == i)
            if c >= 0.8 * len(q) - 1e-9:
                out.append((i, k, len(q), c))
    return sorted(out)


def world():
    r = random.Random(9)
    rows, items = list(texts()), []
    for k in range(40):
        t = prose(r, r.choice([2, 4, 5, 9, 25, 60]))
        items.append((k, t))
        w = t.split()
        if len(w) > 20:
            w[k % len(w)] = "other"  # a few shingles are lost
        i = 1000 + k
        rows.append((i, prose(r, 300) + " " + (" ".join(w) if k % 2 else t.upper()) + " " + prose(r, 50), "en", "s", 0))
    items += [(90, None), (91, ""), (None, "some text of five words"), (92, items[5][1])]
    return rows, items


def test_matches_brute_force(spark):
    rows, items = world()
    docs, bench = clashing(spark.createDataFrame(rows, SCHEMA)), clashing(spark.createDataFrame(items, "item_id long, text string"))
    want = brute(rows, items)
    for bound in (10**6, 0):  # broadcast and shuffled
        got = decontaminate.contaminated(docs, bench, broadcast_rows=bound).collect()
        assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_common) for r in got) == want
    assert len(want) > 30


def test_clean_and_empty(spark):
    rows, items = world()
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    bad = {i for i, *_ in brute(rows, items)}
    kept = decontaminate.clean(docs, bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in rows if r[0] not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.contaminated(spark.createDataFrame([], SCHEMA), bench).collect() == []
