"""Each stage of the pipeline against brute force on its own input."""

import hashlib
import random

import corpus_pipeline
import pytest

from spanloom.llm import queries, toxicity

from . import test_decontaminate, test_linededup, test_mixing, test_simhash
from .corpus import SCHEMA, clashing, prose


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark: copies, near copies, repeated lines, leaks, toxic texts, nulls."""
    at, r = str(tmp_path_factory.mktemp("world")), random.Random(12)
    bench = [(k, prose(r, 40)) for k in range(5)]
    passage = " ".join(prose(r, 60).split())
    rows = []
    for i in range(80):
        t = prose(r, r.choice([20, 60, 150]))
        if i % 10 == 1:
            t += "\nyou are an idiot and a worthless clown."
        if i % 10 == 2:
            t += "\n" + " ".join(bench[i % 5][1].split()) + "\n" + prose(r, 8)
        if i % 10 in (3, 4):
            t = prose(r, 9) + "\n" + passage + "\n" + t
        rows.append((i, t))
    rows += [(100 + i, rows[5][1]) for i in range(4)] + [(200, rows[6][1].replace(" ", "  ", 3)), (201, None), (202, "")]
    # ids that repeat: with the same text, with another one, with a copy of another document's, and without an id
    rows += [(7, rows[7][1]), (8, prose(r, 40)), (9, rows[5][1]), (None, rows[5][1]), (None, prose(r, 30))]
    docs = [(i, t, r.choice(["en", "de"]), r.choice(["s1", "s1", "s2", None]), None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 1)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, bench


def rows_of(d):
    return [tuple(x) for x in d.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def alike(rows):
    return sorted(rows, key=repr)


def test_stages(spark, world):
    at, docs, bench = world
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)

    f = dict(corpus_pipeline.STAGES)
    assert list(f) == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]

    clean = rows_of(f["toxicity"](spark, frame(docs), at))
    grammar = toxicity.Grammar(toxicity.learn(frame(docs), spark.read.parquet(f"{at}/labels.parquet")))
    assert alike(clean) == alike([d for d in docs if grammar.score(d[1])[0] < 0.3])
    assert not any(d[0] is not None and d[0] % 10 == 1 and d[0] < 80 for d in clean) and len(clean) == len(docs) - 8

    lined = rows_of(f["line_dedup"](spark, frame(clean), at))
    gone = {}
    for i, h, line, _, _, _, removed in test_linededup.brute(clean):
        if removed:
            gone.setdefault((i, h), set()).add(line)
    want = []
    for d in clean:
        row = d[0], test_linededup.text_hash(d[1])
        t = "\n".join(x for k, x in enumerate((d[1] or "").split("\n")) if k not in gone.get(row, ()))
        if row not in gone:
            want.append(d)
        elif t.strip():
            want.append((d[0], t, d[2], d[3], len(t)))
    assert alike(lined) == alike(want) and gone

    one = rows_of(f["simhash_near_dedup"](spark, frame(lined), at))
    groups = test_simhash.brute_groups([d[1] for d in lined])
    first = {}
    for d, g in zip(lined, groups):
        first[g] = min(first.get(g, d), d, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5((x[1] or "").encode()).hexdigest()))
    assert alike(one) == alike(first.values()) and len(one) < len(lined)

    free = rows_of(f["benchmark_decontamination"](spark, frame(one), at))
    leaks = [d for d in one if test_decontaminate.brute([(0, *d[1:])], bench)]
    assert alike(free) == alike([d for d in one if d not in leaks]) and leaks

    test_mixing.check(free, f["source_mixing"](spark, frame(free), at).collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_clashing_columns(spark, world, k):
    at, docs, _ = world
    name, stage = corpus_pipeline.STAGES[k]
    plain = spark.createDataFrame(docs, SCHEMA)
    got = stage(spark, clashing(plain), at)
    want = stage(spark, plain, at)
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count()
    if k < 4:
        assert got.columns == clashing(plain).columns


def test_run_applies_the_stages(spark, world):
    at, docs, _ = world
    got = {r.doc_id for r in corpus_pipeline.run(spark, at).collect()}
    d = spark.createDataFrame(docs, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, at)
    assert got == {r.doc_id for r in d.collect()}


def test_entry_registers_all():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []
    for name, q in queries.QUERIES.items():
        assert q(spark, at).collect() == [], name
