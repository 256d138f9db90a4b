import hashlib
import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import build
from spanloom.sources import grammar, readers, recipes, sinks
from spanloom.streaming import pipeline


def test_court_cases(spark):
    m = lambda a, b, t, e, i: {"start_offset": a, "end_offset": b, "span_text": t, "entity_type": e, "identifier_type": i}
    rec = [("d", "Ann in Rome", {"a1": {"entity_mentions": [m(0, 3, "Ann", "PERSON", "DIRECT")]}, "a2": {"entity_mentions": [m(0, 3, "Ann", "PERSON", "DIRECT"), m(7, 11, "Rome", "LOC", "QUASI")]}})]
    s = "doc_id string, text string, annotations map<string, struct<entity_mentions: array<struct<start_offset:int,end_offset:int,span_text:string,entity_type:string,identifier_type:string>>>>"
    r = readers.court_cases(spark.createDataFrame(rec, s)).first()
    assert sorted((x.label, x.start, x.source) for x in r.spans) == [("LOC/QUASI", 7, "gold:a2"), ("PERSON/DIRECT", 0, "gold:a1"), ("PERSON/DIRECT", 0, "gold:a2")]


TOK = "doc_id string, tokens array<string>, trailing_whitespace array<boolean>, ent_tags array<string>"


def test_token_corpus(spark):
    rec = [("d", ["Ann", "Lee", "in", "Rome", ",", "now"], [True, True, True, False, True, False], ["B-NAME", "I-NAME", "O", "I-LOC", "O", "I-X"])]
    r = readers.token_corpus(spark.createDataFrame(rec, TOK)).first()
    assert r.text == "Ann Lee in Rome, now" and [(x.surface, x.label) for x in r.spans] == [("Ann Lee", "NAME"), ("Rome", "LOC"), ("now", "X")]
    with pytest.raises(Exception, match="unfilled"):
        readers.token_corpus(spark.createDataFrame([("d", ["{x}"], [False], ["B-NAME"])], TOK)).collect()
    with pytest.raises(Exception, match="lengths differ"):
        readers.token_corpus(spark.createDataFrame([("d", ["a"], [False, True], ["O"])], TOK)).collect()
    f = readers.fill_placeholders(spark.createDataFrame([("d", ["{n}", "and", "{n}"], [True, True, False], ["B-NAME", "O", "B-NAME"])], TOK), "s")
    x = readers.token_corpus(f).first()
    assert len(x.spans) == 2 and x.spans[0].surface == x.spans[1].surface and " " in x.spans[0].surface


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "hello"), (1, 0, "user", "hi 😀"), (1, 1, "user", "Ann"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    r = readers.conversations(turns).first()
    assert r.text == "User: hi 😀\nAssistant: hello\nUser: Ann\n"
    assert [r.text[a:b] for a, b in r.ignore] == ["User: ", "Assistant: ", "User: "]
    s = readers.rebase_spans(spark.createDataFrame([(1, 1, "user", 0, 3)], "conv_id long, turn long, role string, start int, end int"), turns).first()
    assert r.text[s.start:s.end] == "Ann"
    with pytest.raises(Exception, match="missing message"):
        readers.rebase_spans(spark.createDataFrame([(1, 9, "user", 0, 3)], "conv_id long, turn long, role string, start int, end int"), turns).collect()


def test_json_spans(spark):
    rows = [("u1", "Ann Black", '[{"start": 4, "end": 9, "label": "name", "text": "black"}]'), ("u2", "id 77", "[{'start': 3, 'end': 5, 'label': 'id', 'text': 77}]"), ("u3", "none", "[]")]
    d = spark.createDataFrame(rows, "uid string, text string, spans string")
    got = {r.doc_id: r for r in readers.json_spans(d, "x", "text", "spans", F.col("uid"), F.col("uid"), fold_surface=True).collect()}
    assert got["x_u1"].spans[0].surface == "Black" and got["x_u2"].spans[0].surface == "77" and got["x_u3"].spans == [] and got["x_u1"].cluster_id == "x:u1"
    with pytest.raises(Exception, match="neither JSON"):
        readers.json_spans(spark.createDataFrame([("u", "t", "{{")], d.schema), "x", "text", "spans", F.col("uid")).collect()


def test_zipped(spark):
    d = spark.createDataFrame([((["a", "b"], [1, 2]),), ((["a"], [1, 2]),)], "s struct<k: array<string>, v: array<int>>")
    z = lambda rows: rows.select(readers.zipped(F.col("s"), ("k", "v")).alias("z")).collect()
    assert [tuple(x) for x in z(d.where("size(s.k) = 2"))[0].z] == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="ragged"):
        z(d)


def test_prediction_files(spark, tmp_path):
    p = spark.createDataFrame([("d1", []), ("d2", [("d2", 0, 2, "PERSON", "name", 0.5, "m", "ab")])], "doc_id string, spans array<struct<doc_id:string,start:int,end:int,label_canonical:string,label_raw:string,score:double,source:string,surface:string>>")
    sinks.write_predictions(p, {"system": "s", "n_docs": 2}, str(tmp_path / "p"))
    meta, rows = readers.read_predictions(spark, str(tmp_path / "p"))
    meta = json.loads(meta) if isinstance(meta, str) else meta
    assert meta["system"] == "s" and {r.doc_id: len(r.spans) for r in rows.collect()} == {"d1": 0, "d2": 1}
    h = spark.createDataFrame([("s", "/a", "1"), ("s", "file:///a", "2")], "system string, docs_path string, path string")
    with pytest.raises(ValueError, match="duplicate"):
        readers.prediction_index(h)


def test_ledger_and_stores(spark, tmp_path):
    led = str(tmp_path / "ledger")
    sinks.append_ledger(spark, led, {"unit": "a", "hours": 1.5})
    sinks.append_ledger(spark, led, {"unit": "b"}, headline=True, revision="abc")
    for bad in (None, "abc-dirty"):
        with pytest.raises(ValueError):
            sinks.append_ledger(spark, led, {}, headline=True, revision=bad)
    assert sinks.read_ledger(spark, led).count() == 2
    sinks.export_flat(sinks.read_ledger(spark, led), {"unit": "$.unit"}, str(tmp_path / "flat"))
    assert {r.unit for r in spark.read.parquet(str(tmp_path / "flat")).collect()} == {"a", "b"}
    docs = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")
    assert sinks.dataset_hash(docs) == sinks.dataset_hash(docs.orderBy("doc_id")) != sinks.dataset_hash(docs.where("doc_id = 1"))
    snap = str(tmp_path / "snap")
    assert sinks.valid_snapshot(spark, snap, "1") is None
    sinks.write_snapshot(docs, snap, "1")
    assert sinks.valid_snapshot(spark, snap, "1").count() == 2 and sinks.valid_snapshot(spark, snap, "2") is None
    store = str(tmp_path / "store")
    v = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "text string, v double")
    assert sinks.add_new(v, "text", store) == 2 and sinks.add_new(v.union(spark.createDataFrame([("z", 3.0)], v.schema)), "text", store) == 1


def test_jsonl_and_logs(spark, tmp_path):
    d = spark.createDataFrame([("a", "t")], "doc_id string, text string")
    sinks.write_jsonl(d, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j")).first().text == "t"
    lines = spark.createDataFrame([("run a step 5 loss 0.25",), ("noise",)], "value string")
    assert [tuple(r) for r in readers.training_log(lines).collect()] == [("a", 5, 0.25)]
    j = spark.createDataFrame([('{"h": 1}',), ("{broken",)], "value string")
    assert [r.h for r in readers.tolerant_json(j, "h int").collect()] == [1]


def test_seeded_conversations(spark):
    seeds = spark.range(400).withColumnRenamed("id", "conv_id")
    d = grammar.expand(seeds.withColumn("text", F.lit("x")), "conv_id", "s")
    rows = {r.doc_id: r for r in d.collect()}
    assert len(rows) == 400 and all(r.text[s.start:s.end] == s.surface for r in rows.values() for s in r.spans)
    by = {}
    for r in rows.values():
        by.setdefault(r.cluster_id, []).append(r)
    assert {k.split(":")[0] for k in by} == set(grammar.TEMPLATES) and 0.2 < sum(len(v) for k, v in by.items() if k.endswith("spoken")) / 400 < 0.5
    assert len(by["card:typed"]) > len(by["birth:typed"]) + len(by["birth:spoken"]) - 30
    for r in by["decoy:typed"] + by["decoy:spoken"]:
        assert r.spans == [] and any(c.isdigit() for c in r.text)
    for r in by["card:typed"]:
        card = next(s.surface for s in r.spans if len(s.surface) == 16)
        assert sum((2 * int(c) - 9 * (c > "4")) if i % 2 == 0 else int(c) for i, c in enumerate(card)) % 10 == 0 and len(r.spans) == 5
    for r in by["card:spoken"]:
        said = [s.surface for s in r.spans if s.label == "ACCOUNT_NUMBER"]
        assert len(said) == 3 and not any(c.isdigit() for s in said for c in s) and "uh " in said[1]
    again = {r.doc_id: r for r in grammar.expand(seeds.repartition(7), "conv_id", "s").collect()}
    assert again == rows and grammar.expand(seeds, "conv_id", "t").collect() != list(rows.values())
    assert grammar.expand(seeds.limit(0), "conv_id", "s").collect() == []


def lay(path, name, data):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(data)
    return hashlib.sha256(data).hexdigest()


def test_recipe_sets_aside_what_it_cannot_use(spark, tmp_path):
    good = {"id": "7", "language": "en", "source_text": "Ann met Bo", "privacy_mask": "[{'start': 0, 'end': 3, 'label': 'GIVENNAME', 'value': 'Ann'}]"}
    rows = [json.dumps(good), json.dumps(good | {"id": "8", "language": "fr"}), json.dumps(good | {"id": None, "privacy_mask": None}), "{broken", "[1]", json.dumps(good | {"privacy_mask": "no spans"}), json.dumps({"language": "en"}), ""]
    a = lay(tmp_path / "in", "a.jsonl", "\n".join(rows).encode() + b"\n\xff\xfe\n")
    lay(tmp_path / "in", "b.jsonl", json.dumps(good | {"id": "9", "source_text": "x" * 3_000_000}).encode())
    lay(tmp_path / "in", "_SUCCESS", b"")
    docs, aside = recipes.recipe(spark, "ai4privacy", str(tmp_path / "in"), {"a.jsonl": a})
    got = {r.doc_id: r for r in docs.collect()}
    assert {"ai4privacy_7", "ai4privacy_9"} < set(got) and len(got) == 3 and got["ai4privacy_7"].spans[0].surface == "Ann" and len(got["ai4privacy_9"].text) == 3_000_000
    assert sorted((r.file, r.pos, r.fault) for r in aside.collect()) == [("a.jsonl", 3, "no JSON"), ("a.jsonl", 4, "no object"), ("a.jsonl", 5, "spans"), ("a.jsonl", 6, "lacks source_text"), ("a.jsonl", 7, "no UTF-8")]
    with pytest.raises(Exception, match="not the pinned"):
        recipes.load(spark, f"file://{tmp_path}/in", hashes={"b.jsonl": "0" * 64}).count()
    with pytest.raises(Exception, match="aren't there"):
        recipes.load(spark, str(tmp_path / "in"), hashes={"c.jsonl": "0" * 64}).count()
    assert recipes.load(spark, str(tmp_path / "in")).rdd.getNumPartitions() == 2


def test_every_recipe_builds_documents(spark, tmp_path):
    court = [{"doc_id": "c1", "text": "Ann won", "annotations": {"x": {"entity_mentions": [{"start_offset": 0, "end_offset": 3, "span_text": "Ann", "entity_type": "PERSON", "identifier_type": "DIRECT"}]}}}]
    tokens = {"tokens": ["I", "am", "{}", "."], "trailing_whitespace": [True, True, False, False], "ent_tags": ["O", "O", "B-NAME", "O"]}
    files = {
        "tab_direct": json.dumps(court), "tab_quasi": json.dumps(court), "spy_medical": json.dumps(tokens) + "\n" + json.dumps(tokens | {"tokens": ["x"]}), "spy_legal": json.dumps(tokens),
        "pii_trace": json.dumps({"conv_id": "k", "messages": [{"turn": 0, "role": "user", "text": "Ann here"}], "spans": [{"turn": 0, "role": "user", "start": 0, "end": 3, "label": "name", "surface": "Ann"}]}),
        "nemotron": json.dumps({"uid": "u", "locale": "us", "domain": "d", "document_type": "t", "text": "Ann", "spans": json.dumps([{"start": 0, "end": 3, "label": "first_name", "text": "ANN"}])}),
        "gretel": json.dumps({"index": 5, "language": "English", "document_type": "t", "generated_text": "Ann", "pii_spans": json.dumps([{"start": 0, "end": 3, "label": "name"}])}),
        "ai4privacy": json.dumps({"id": "1", "language": "en", "source_text": "Ann", "privacy_mask": "[]"}), "fresh_real": json.dumps({"doc_id": "f", "text": "Ann", "spans": "[]"}),
    }
    assert set(files) == set(recipes.RECIPES)
    for name, data in files.items():
        lay(tmp_path / name, "r.json", data.encode())
        docs, aside = recipes.recipe(spark, name, str(tmp_path / name))
        rows = docs.collect()
        assert len(rows) == 1 and [r.fault for r in aside.collect()] == (["token lengths"] if name == "spy_medical" else [])
        for s in rows[0].spans:
            assert s.surface is None or rows[0].text[s.start:s.end] == s.surface
        if name.startswith("spy"):
            assert rows[0].text.startswith("I am ") and "{" not in rows[0].text and rows[0].spans[0].label == "NAME"


def test_store_is_taken_up_where_it_was_cut_off(spark, tmp_path):
    at, d = str(tmp_path / "store"), spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    bad = lambda x: x.withColumn("f", F.when(F.col("k") == 250, F.raise_error(F.lit("power cut"))).otherwise(F.col("v") + 1))
    with pytest.raises(Exception, match="power cut"):
        sinks.write_store(d, at, "k", bad, "v1", shards=12, wave=3)
    whole = {r.shard for r in sinks.store_manifest(spark, at).collect()}
    assert len(whole) < 12 and 0 < sinks.read_store(spark, at).count() < 300 if whole else True
    good = lambda x: x.withColumn("f", F.col("v") + 1)
    wrote = sinks.write_store(d, at, "k", good, "v1", shards=12, wave=3)
    assert not set(wrote) & whole and len(wrote) + len(whole) == 12
    rows = sorted((r.k, r.v, r.f) for r in sinks.read_store(spark, at).collect())
    assert rows == [(i, 2 * i, 2 * i + 1) for i in range(300)]
    assert sinks.write_store(d.repartition(9), at, "k", good, "v1", shards=12) == []
    assert len(sinks.write_store(d.withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v"))), at, "k", good, "v1", shards=12)) == 1
    assert len(sinks.write_store(d, at, "k", good, "v2", shards=12)) == 12
    sinks.write_store(d.where("k < 1"), at, "k", good, "v2", shards=12)
    assert [r.k for r in sinks.read_store(spark, at).collect()] == [0]


def test_streaming(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(1, "write a@b.co now"), (2, "none")], "doc_id long, text string").write.parquet(src)
    s = pipeline.surfaces(pipeline.documents(spark, src, "doc_id long, text string"))
    pipeline.append_once(s, out, cp).awaitTermination()
    assert [(r.doc_id, r.kind, r.surface) for r in spark.read.parquet(out).collect()] == [(1, "email", "a@b.co")]
    pipeline.append_once(s, out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    ev = str(tmp_path / "ev")
    spark.sql("select 1L event_id, timestamp'2024-01-01 00:10:00' ts, 7L user_id, 'x' event_type, 2.0D value union all select 2, timestamp'2024-01-01 00:50:00', 7, 'x', 3.0").write.parquet(ev)
    e = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(ev)
    q = pipeline.windowed(e).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.value) for r in spark.sql("select n, value from w").collect()] == [(2, 5.0)]


def test_filtered_rows_are_not_refused(spark, tmp_path):
    at = str(tmp_path / "texts")
    spark.createDataFrame([(1, "abc"), (2, "ab\n")], "doc_id long, text string").write.parquet(at)
    spans = F.concat(F.lit('[{"start": 0, "end": 3, "label": "email", "text": "'), "text", F.lit('"}]'))
    d = spark.read.parquet(at).where(F.col("text").rlike("^[a-z]{3}")).withColumn("spans", spans)
    out = readers.json_spans(d, "x", "text", "spans", F.col("doc_id"), fold_surface=True).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.surface")
    assert out.collect() == [("x_1", "abc")]
    with pytest.raises(Exception, match="neither JSON nor a literal"):
        readers.json_spans(spark.read.parquet(at).withColumn("spans", spans), "x", "text", "spans", F.col("doc_id")).collect()
