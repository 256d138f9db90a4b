"""More registered queries: readers, sinks, guards, selections, text and probability functions, training rows, decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import prob, text
from spanloom.operators import build, calibration, diagnostics, leak, questions, series, spans, stats, taxonomy, training, vectors, windows
from spanloom.plans.catalog import query, rounded, values
from spanloom.plans.demo import documents, named, pick, u
from spanloom.schema import PII_TYPES, SpanError, validate_predictions
from spanloom.session import shared_dir, table
from spanloom.sources import readers, sinks


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def draw(salt: str, *keys: str):
    return prob.unit(salt, *[F.col(k) for k in keys or ("doc_id",)])


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# One span a document, by draw: a stretch of 5 to 14 characters, its label, and a score. Texts under 40 characters have none.
SPAN = f"""span AS (SELECT doc_id, floor({u('at', 'doc_id')} * (length(text) - 20))::BIGINT AS "start", floor({u('at', 'doc_id')} * (length(text) - 20))::BIGINT + 5 + floor({u('long', 'doc_id')} * 9.99e0)::BIGINT AS "end",
{pick(f"least(8, floor({u('what', 'doc_id')} * 9))::INT", PII_TYPES)} label, floor({u('sure', 'doc_id')} * 1000) / 1000 score FROM documents WHERE length(text) >= 40)"""


def span(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, start, end, label, score) as in SPAN."""
    start = F.floor(draw("at") * (F.length("text") - 20))
    d = documents(spark, sf).where(F.length("text") >= 40).select("doc_id", start.cast("int").alias("start"), (start + 5 + F.floor(draw("long") * 9.99)).cast("int").alias("end"), named(F.least(F.lit(8), F.floor(draw("what") * 9)), PII_TYPES).alias("label"), (F.floor(draw("sure") * 1000) / 1000).alias("score"))
    return d


# Readers and sinks ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR doc_id, length(text) n, md5(text) digest, source cluster_id FROM documents")
def jsonl_round_trip(spark, sf):
    """Documents written as JSON lines and read again."""
    at = folder(spark, "jsonl")
    sinks.write_jsonl(documents(spark, sf).select(F.col("doc_id").cast("string"), "text", F.col("source").alias("cluster_id")), at)
    return readers.read_jsonl(spark, at).select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"), "cluster_id")


@query(f'WITH {SPAN} SELECT doc_id::VARCHAR doc_id, "start", "end", label, score, \'drawn\' system FROM span')
def prediction_file(spark, sf):
    """Predictions written with a header and read again."""
    at = folder(spark, "predictions")
    one = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "start", "end", F.col("label").alias("label_canonical"), F.col("label").alias("label_raw"), "score")
    sinks.write_predictions(span(spark, sf).select(F.col("doc_id").cast("string"), F.array(one).alias("spans")), {"system": "drawn"}, at)
    meta, got = readers.read_predictions(spark, at)
    return got.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", F.col("s.label_canonical").alias("label"), "s.score", F.lit(meta["system"]).alias("system"))


@query("SELECT count(*) n, true same, false stale FROM documents")
def snapshot_round_trip(spark, sf):
    """A snapshot is read under its own taxonomy version and refused under another."""
    at = folder(spark, "snapshot")
    sinks.write_snapshot(documents(spark, sf).select("doc_id", "text"), at, "v1")
    back = sinks.valid_snapshot(spark, at, "v1")
    return back.agg(F.count("*").alias("n"), F.lit(True).alias("same"), F.lit(sinks.valid_snapshot(spark, at, "v2") is not None).alias("stale"))


@query("""WITH k AS (SELECT doc_id::VARCHAR k, sha256(text) h FROM documents), p AS (SELECT substr(sha256(k), 1, 3) piece, sha256(string_agg(k || ':' || h, chr(10) ORDER BY k || ':' || h)) h FROM k GROUP BY 1)
SELECT substr(sha256(string_agg(piece || h, '' ORDER BY piece || h)), 1, 16) digest FROM p""")
def dataset_digest(spark, sf):
    return rows(spark, [(sinks.dataset_hash(documents(spark, sf)),)], "digest string")


@query(f"SELECT CASE WHEN {u('part', 'doc_id')} < 0.2e0 THEN 'calib' ELSE 'test' END part, count(*) n, sum(length(text))::BIGINT chars FROM documents GROUP BY 1")
def materialized_parts(spark, sf):
    at = folder(spark, "parts")
    sinks.materialize(documents(spark, sf).select("doc_id", "text", F.when(draw("part") < 0.2, "calib").otherwise("test").alias("part")), at)
    return spark.read.parquet(at).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT (SELECT count(DISTINCT source) FROM documents WHERE lang = 'en') first_added, (SELECT count(DISTINCT source) FROM documents) - (SELECT count(DISTINCT source) FROM documents WHERE lang = 'en') then_added, (SELECT count(DISTINCT source) FROM documents) held")
def store_growth(spark, sf):
    """A store takes only keys that it lacks."""
    at, d = folder(spark, "store"), documents(spark, sf).select("source", "lang")
    a = sinks.add_new(d.where("lang = 'en'").select("source"), "source", at)
    b = sinks.add_new(d.select("source"), "source", at)
    return rows(spark, [(a, b, spark.read.parquet(at).count())], "first_added long, then_added long, held long")


@query(f'WITH {SPAN} SELECT label, count(*) n, round(sum(score), 6) score FROM span GROUP BY label')
def feature_store(spark, sf):
    at = folder(spark, "features")
    sinks.write_store(span(spark, sf), at, "doc_id")
    return rounded(sinks.read_store(spark, at).groupBy("label").agg(F.count("*").alias("n"), F.sum("score").alias("score")), "score")


@query("""SELECT doc_id, 0::BIGINT AS "start", 4::BIGINT AS "end", CASE WHEN doc_id % 3 = 0 THEN 'PERSON/DIRECT' WHEN doc_id % 3 = 1 THEN 'LOC/QUASI' ELSE 'ORG/NO_MASK' END label, CASE WHEN doc_id % 3 = 0 THEN 'PERSON' WHEN doc_id % 3 = 1 THEN 'IGNORE' ELSE 'NOT_PII' END canonical, 'gold:' || a source, 2::BIGINT n_annotators
FROM documents, (VALUES ('ann1'), ('ann2')) t(a) WHERE length(text) >= 4""")
def court_case_spans(spark, sf):
    """Court records: mentions of all annotators, labelled entity/identifier, mapped to outcomes."""
    kind = F.pmod("doc_id", F.lit(3)).cast("int")
    m = F.struct(F.lit(0).alias("start_offset"), F.lit(4).alias("end_offset"), F.substring("text", 1, 4).alias("span_text"), named(kind, ("PERSON", "LOC", "ORG")).alias("entity_type"), named(kind, ("DIRECT", "QUASI", "NO_MASK")).alias("identifier_type"))
    who = F.struct(F.array(m).alias("entity_mentions"))
    d = documents(spark, sf).where(F.length("text") >= 4).select("doc_id", "text", F.create_map(F.lit("ann1"), who, F.lit("ann2"), who).alias("annotations"))
    s = readers.court_cases(d).select("doc_id", "n_annotators", F.explode("spans").alias("s")).select("doc_id", "n_annotators", "s.start", "s.end", "s.label", "s.source")
    part = F.split("label", "/")
    return s.withColumn("canonical", taxonomy.court_label(part[0], part[1]))


@query("""SELECT 'nem_' || doc_id doc_id, 'nem:' || source cluster_id, 0::BIGINT AS "start", 3::BIGINT AS "end", 'email' label, substr(text, 1, 3) surface FROM documents WHERE regexp_matches(text, '^[A-Za-z]{3}')""")
def json_span_rows(spark, sf):
    """Spans as JSON text or as a Python literal; a surface that equals its slice but for case becomes the slice."""
    said = F.upper(F.substring("text", 1, 3))
    plain = F.concat(F.lit('[{"start": 0, "end": 3, "label": "email", "text": "'), said, F.lit('"}]'))
    literal = F.concat(F.lit("[{'start': '0', 'end': 3, 'label': 'email', 'text': '"), said, F.lit("', 'value': None}]"))
    d = documents(spark, sf).where(F.col("text").rlike("^[A-Za-z]{3}")).withColumn("spans", F.when(F.col("doc_id") % 2 == 0, plain).otherwise(literal))
    out = readers.json_spans(d, "nem", "text", "spans", F.col("doc_id"), F.col("source"), fold_surface=True)
    return out.select("doc_id", "cluster_id", F.explode("spans").alias("s")).select("doc_id", "cluster_id", "s.start", "s.end", "s.label", "s.surface")


@query("SELECT conv_id, turn, role, length(text) n FROM conversations WHERE text IS NOT NULL")
def zipped_turns(spark, sf):
    """A struct of arrays, one a column, becomes rows again."""
    t = table(spark, sf, "conversations").where("text is not null")
    row = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = t.groupBy("conv_id").agg(row.alias("r")).select("conv_id", F.struct(F.col("r.turn").alias("turn"), F.col("r.role").alias("role"), F.col("r.text").alias("text")).alias("columns"))
    d = g.select("conv_id", F.explode(readers.zipped(F.col("columns"), ("turn", "role", "text"))).alias("x"))
    return d.select("conv_id", "x.turn", "x.role", F.length("x.text").alias("n"))


@query("SELECT 'r' || (doc_id % 3) run, doc_id step, (n_chars / 8)::DOUBLE loss FROM documents")
def parsed_training_log(spark, sf):
    line = F.concat(F.lit("12:00 run r"), (F.col("doc_id") % 3).cast("string"), F.lit(" at step "), F.col("doc_id").cast("string"), F.lit(": loss "), (F.col("n_chars") / 8).cast("decimal(20,3)").cast("string"))
    lines = documents(spark, sf).select(line.alias("value")).unionByName(rows(spark, [("warming up",), ("run x without a step",)], "value string"))
    return readers.training_log(lines)


@query("SELECT doc_id unit, n_chars n FROM documents WHERE doc_id % 5 <> 0")
def tolerant_rows(spark, sf):
    """Rows of a JSON-lines text; every fifth line is broken and left out."""
    good = F.to_json(F.struct(F.col("doc_id").alias("unit"), F.col("n_chars").alias("n")))
    return readers.tolerant_json(documents(spark, sf).select(F.when(F.col("doc_id") % 5 == 0, F.substring(good, 1, 9)).otherwise(good).alias("value")), "unit bigint, n bigint")


# Guards and labels ---------------------------------------------------------------------------------------------------


@query("""SELECT 'kept' kind, count(*) n FROM documents WHERE length(text) >= 3 AND doc_id % 500 <> 1 UNION ALL SELECT 'offset out of range', count(*) FROM documents WHERE length(text) >= 3 AND doc_id % 500 = 1
UNION ALL SELECT 'duplicate doc_id', (SELECT count(*) FROM documents WHERE length(text) >= 3 AND doc_id % 1000 = 7)""")
def built_and_rejected(spark, sf):
    """A build quarantines records with a bad span and later records of one id."""
    d = documents(spark, sf).where(F.length("text") >= 3)
    end = F.when(F.col("doc_id") % 500 == 1, F.length("text") + 5).otherwise(3)
    one = F.struct(F.lit(0).alias("start"), end.cast("int").alias("end"), F.lit("email").alias("label"), F.lit(None).cast("string").alias("surface"), F.lit("gold").alias("source"))
    raws = d.select("doc_id", "text", F.col("source").alias("cluster_id"), F.array(one, one).alias("spans"))
    raws = raws.unionByName(raws.where("doc_id % 1000 = 7").withColumn("text", F.concat("text", F.lit(" again"))))
    good, bad = build.build(raws, "nemotron", spark, budget=0.05)
    every = good.select(F.lit("kept").alias("kind")).unionByName(bad.select(F.col("error").alias("kind")))
    kinds = rows(spark, [("kept",), ("offset out of range",), ("duplicate doc_id",)], "kind string")
    return kinds.join(every.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").na.fill(0)


@query("SELECT * FROM (VALUES ('all in place', false), ('unknown document', true), ('beyond the text', true)) t(what, refused)")
def refused_predictions(spark, sf):
    docs, p = documents(spark, sf), span(spark, sf).select("doc_id", "start", "end")
    first = p.orderBy("doc_id").limit(1)
    out = []
    for what, d in (("all in place", p), ("unknown document", first.withColumn("doc_id", F.lit(-1).cast("long"))), ("beyond the text", first.withColumn("end", F.lit(1 << 30)))):
        try:
            validate_predictions(docs, d)
            out.append((what, False))
        except SpanError:
            out.append((what, True))
    return rows(spark, out, "what string, refused boolean")


@query(f"WITH {SPAN} SELECT label, count(*) n FROM span WHERE label NOT IN ('DATE', 'SECRET') GROUP BY label")
def admissible_labels(spark, sf):
    return taxonomy.filter_admissible(span(spark, sf), "spy_legal").groupBy("label").agg(F.count("*").alias("n"))


_NATIVE = [(r, taxonomy.NODE_OF.get(r, r if r in taxonomy.PARENTS else "pii")) for r in sorted({r.lower() for d in ("spy", "pii_trace", "nemotron", "gretel") for r in taxonomy.LABELS[d]} | set(taxonomy.NODE_OF) | (set(taxonomy.PARENTS) - {"pii"}))]


@query(f"WITH {SPAN} SELECT CASE WHEN label = 'EMAIL' THEN 'IGNORE' ELSE 'OTHER_PII' END label, count(*) n FROM span GROUP BY 1")
def anonymous_labels(spark, sf):
    return taxonomy.anonymous(span(spark, sf).withColumn("raw", F.lower("label")), rows(spark, [("email",)], "raw string")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {SPAN} SELECT doc_id, 'held-out name' reason FROM span WHERE label = 'URL' UNION ALL SELECT doc_id, 'forbidden range' FROM span WHERE "start" < 50""")
def leaking_questions(spark, sf):
    s = span(spark, sf)
    q = s.select("doc_id", "start", "end", F.array("label", F.lit(questions.NONE)).alias("options"))
    forbidden = s.select("doc_id", F.lit(0).alias("start"), F.lit(50).alias("end"))
    return questions.leaks(q, rows(spark, [("URL",)], "raw string"), forbidden)


@query(f"""WITH {SPAN}, t AS (SELECT s.doc_id, s."start" + 4 AS "start", s."end" + 4 AS "end", d.lang, s."start" a, s."end" b FROM span s JOIN documents d USING (doc_id)) SELECT doc_id, "start", "end" FROM t WHERE lang <> 'en' AND NOT ("start" < b AND "end" > a)""")
def open_zones(spark, sf):
    """Teacher spans of families that a language's gold lacks, clear of that gold."""
    s = span(spark, sf).join(documents(spark, sf).select("doc_id", F.col("lang").alias("source")), "doc_id")
    langs = documents(spark, sf).select(F.col("lang").alias("source")).distinct()
    has = langs.select("source", F.when(F.col("source") == "en", F.array(F.lit("ssn"), F.lit("iban"))).otherwise(F.array(F.lit("ssn"))).alias("nodes"))
    t = s.select("doc_id", (F.col("start") + 4).alias("start"), (F.col("end") + 4).alias("end"), "source", F.array(F.lit("ssn"), F.lit("iban")).alias("nodes"))
    return spans.teacher_zones(t, s, has).select("doc_id", "start", "end")


@query(f"""WITH {SPAN} SELECT CASE WHEN label IN ('URL', 'DATE') THEN 'unknown_label' WHEN "end" > 400 THEN 'bad_bounds' WHEN score < 0.4e0 THEN 'below_floor' ELSE 'ok' END status, count(*) n FROM span GROUP BY 1""")
def admitted(spark, sf):
    known = rows(spark, [(x,) for x in PII_TYPES if x not in ("URL", "DATE")], "label string")
    return spans.admit(span(spark, sf).withColumn("length", F.lit(400)), known, 0.4).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {SPAN}, w AS (SELECT *, ("start" // 100) * 100 ws, least(("start" // 100) * 100 + 100, length(text)) we FROM span JOIN documents USING (doc_id)), c AS (SELECT *, least("end", we) e FROM w) SELECT doc_id, "start", e AS "end" FROM c WHERE NOT ("start" = ws AND ws > 0 OR e = we AND we < length(text))""")
def uncut_detections(spark, sf):
    """Detections in windows of 100 characters without those that touch an inner edge."""
    d = span(spark, sf).join(documents(spark, sf).select("doc_id", F.length("text").alias("doc_length")), "doc_id").withColumn("win_start", F.expr("start div 100 * 100").cast("int"))
    d = d.withColumn("win_end", F.least(F.col("win_start") + 100, F.col("doc_length"))).withColumn("end", F.least("end", "win_end"))
    return spans.drop_cut(d).select("doc_id", "start", "end")


# Text and windows ----------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, a + length(s) - length(regexp_replace(s, '^\\s+', '')) AS "start", greatest(a + 12 - (length(s) - length(regexp_replace(s, '\\s+$', ''))), a + length(s) - length(regexp_replace(s, '^\\s+', ''))) AS "end" FROM (SELECT doc_id, doc_id % 7 a, substr(text, (doc_id % 7 + 1)::INT, 12) s FROM documents WHERE length(text) >= 40 AND length(text) = strlen(text))""")
def trimmed_spans(spark, sf):
    """Stretches of 12 characters without outer whitespace, in texts of ASCII."""
    d = documents(spark, sf).where((F.length("text") >= 40) & (F.length("text") == F.octet_length("text"))).withColumn("a", (F.col("doc_id") % 7).cast("int"))
    return d.select("doc_id", text.trimmed(F.col("text"), F.col("a"), F.col("a") + 12).alias("x")).select("doc_id", "x.*")


_DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


@query(f"SELECT doc_id, array_to_string([CASE WHEN i % 4 = 0 THEN 'uh ' ELSE '' END || {list(_DIGITS)!r}[substr(n, i::INT, 1)::INT + 1] for i in range(1, length(n) + 1)], ' ') said FROM (SELECT doc_id, (doc_id * 7919 + 1000003)::VARCHAR n FROM documents)")
def spelled_numbers(spark, sf):
    n = (F.col("doc_id") * 7919 + 1000003).cast("string")
    return documents(spark, sf).select("doc_id", text.spell(n, "uh").alias("said"))


@query(r"""WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents) SELECT doc_id, list_has_any(w, ['the', 'und']) said FROM w""")
def mentioned_names(spark, sf):
    return documents(spark, sf).select("doc_id", text.mentions(F.col("text"), F.lit("the und number")).alias("said"))


@query("SELECT doc_id, 'Question: ' || lang || chr(10) || '01: ' || source || chr(10) || '02: none' || chr(10) || 'Text: ' || substr(text, 1, 50) prompt FROM documents")
def prompts(spark, sf):
    return documents(spark, sf).select("doc_id", training.prompt(F.col("lang"), F.array("source", F.lit("none")), F.substring("text", 1, 50)).alias("prompt"))


@query('SELECT doc_id, greatest(0, least(n_chars - 64, (a + b - 64) // 2))::BIGINT "from", least(n_chars, greatest(0, least(n_chars - 64, (a + b - 64) // 2)) + 64)::BIGINT "to" FROM (SELECT doc_id, n_chars, n_chars // 3 + 40 a, n_chars // 3 + 45 b FROM documents)')
def centred_windows(spark, sf):
    a = F.expr("n_chars div 3") + 40
    return documents(spark, sf).select("doc_id", windows.centred(F.col("n_chars"), a, a + 5, 64).alias("x")).select("doc_id", "x.*")


@query("""WITH c AS (SELECT doc_id, n_chars n, greatest(1, ceil((n_chars - 100) / 60) + 1)::BIGINT k FROM documents), w AS (SELECT doc_id, n, unnest(range(k)) i FROM c)
SELECT doc_id, i, greatest(0, least(i * 60, n - 100)) "first", least(n, greatest(0, least(i * 60, n - 100)) + 100) "last" FROM w""")
def token_window_ranges(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(windows.token_windows(F.col("n_chars"), 100, 60)).alias("i", "x")).select("doc_id", "i", "x.first", "x.last")


@query("""WITH q AS (SELECT source "window", doc_id pos, length(lang) + 3 tokens FROM documents), r AS (SELECT *, 20 + sum(tokens) OVER (PARTITION BY "window" ORDER BY pos) "last" FROM q) SELECT "window", pos, tokens, "last"::BIGINT "last", ("last" - tokens)::BIGINT "first", "last" <= 60 fits FROM r""")
def packed_questions(spark, sf):
    q = documents(spark, sf).select(F.col("source").alias("window"), F.col("doc_id").alias("pos"), (F.length("lang") + 3).alias("tokens"))
    return training.packed_ranges(q, 20, 60)


@query(f"""WITH {SPAN} SELECT doc_id, "start", "end", label, score, 'x' surface FROM span""")
def normalised_outputs(spark, sf):
    """Model output as a list of entities or as a map of lists by label."""
    s = span(spark, sf)
    flat = F.to_json(F.array(F.struct("start", "end", F.lit("x").alias("text"), "label", "score")))
    nested = F.to_json(F.struct(F.create_map("label", F.array(F.struct("start", "end", F.lit("x").alias("text"), F.col("score").alias("confidence")))).alias("entities")))
    return windows.normalised_output(s.select("doc_id", F.when(F.col("doc_id") % 2 == 0, flat).otherwise(nested).alias("output")))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) + 2 + 3 <= 90 fits FROM documents WHERE regexp_full_match(text, '[A-Za-z \n]*')")
def fitting_texts(spark, sf):
    """Texts of letters and spaces whose words, with those of a prompt and one a label, stay within a limit."""
    d = documents(spark, sf).where(F.col("text").rlike(r"\A[A-Za-z \n]*\z"))
    return d.select("doc_id", text.fits(F.col("text"), F.lit("two words"), F.lit(3), 100).alias("fits"))


@query("SELECT count(*) n, true covered, true small FROM documents WHERE length(text) > 0")
def fitted_windows(spark, sf):
    """Texts cut until each piece has 400 characters at most: the pieces cover the text and are as short as asked."""
    d = documents(spark, sf).where(F.length("text") > 0).select("doc_id", F.lit(0).alias("win"), "text", F.lit(0).alias("start"))
    w = windows.fit_windows(d, lambda t: len(t) <= 400).join(documents(spark, sf).select("doc_id", F.length("text").alias("n")), "doc_id")
    per = w.groupBy("doc_id").agg((F.max("end") == F.max("n")).alias("end_ok"), (F.min("start") == 0).alias("start_ok"), (F.max(F.col("end") - F.col("start")) <= 400).alias("small"))
    return per.agg(F.count("*").alias("n"), F.bool_and(F.col("end_ok") & F.col("start_ok")).alias("covered"), F.bool_and("small").alias("small"))


# Probabilities -------------------------------------------------------------------------------------------------------

_P = f"p AS (SELECT doc_id, [{u('p0', 'doc_id')} + 0.01e0, {u('p1', 'doc_id')} + 0.01e0, {u('p2', 'doc_id')} + 0.01e0] q FROM documents)"


def _probs(spark, sf):
    return documents(spark, sf).select("doc_id", "lang", F.array(*[draw(f"p{i}") + 0.01 for i in range(3)]).alias("q"))


@query(f"WITH {_P}, z AS (SELECT doc_id, [exp(ln(x) / 2e0) for x in q] e FROM p) SELECT doc_id, i, round(e[i + 1] / list_sum(e), 6) p FROM z, (SELECT unnest(range(3)) i)")
def retempered(spark, sf):
    return rounded(_probs(spark, sf).select("doc_id", F.posexplode(prob.retempered(F.col("q"), 2.0)).alias("i", "p")), "p")


@query(f"WITH {_P} SELECT doc_id, round({u('pb', 'doc_id')} * greatest(0, least(1, 1 - q[1] / list_sum(q) - q[2] / list_sum(q))), 6) score FROM p")
def sensitive_scores(spark, sf):
    p = prob.normalised(F.col("q"))
    return rounded(_probs(spark, sf).select("doc_id", prob.sensitive_score(draw("pb"), p[0], F.array(p[1])).alias("score")), "score")


@query("SELECT doc_id, greatest(128, pow(2, ceil(log2(n_chars))))::BIGINT bucket, floor((row_number() OVER (PARTITION BY greatest(128, pow(2, ceil(log2(n_chars)))) ORDER BY doc_id) - 1) / greatest(1, floor(8192 / greatest(128, pow(2, ceil(log2(n_chars)))))))::BIGINT batch FROM documents WHERE n_chars > 0")
def power_buckets(spark, sf):
    return training.bucket_batches(documents(spark, sf).where("n_chars > 0").select("doc_id", "n_chars"), "doc_id", "n_chars", 8192).select("doc_id", "bucket", "batch")


@query("SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'error' END status, count(*) n FROM documents GROUP BY ALL")
def checked_answers(spark, sf):
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.5))).when(k == 1, F.create_map(F.lit("a"), F.lit(1.0))).otherwise(F.create_map(F.lit("a"), F.lit(0.5), F.lit("c"), F.lit(0.5)))
    d = documents(spark, sf).select("source", F.array(F.lit("a"), F.lit("b")).alias("options"), answer.alias("answer"))
    return training.checked_answers(d).groupBy("source", "status").agg(F.count("*").alias("n"))


@query("SELECT round(sum(n_chars * doc_id)::DOUBLE / sum(doc_id), 6) mean FROM documents")
def weighted_loss(spark, sf):
    return rounded(questions.weighted_mean(documents(spark, sf).select(F.col("n_chars").cast("double").alias("loss"), F.col("doc_id").alias("questions"))), "mean")


@query(f"WITH {_P} SELECT doc_id, round(list_sum(q[2:3]), 6) total FROM p")
def slice_totals(spark, sf):
    return rounded(_probs(spark, sf).select("doc_id", prob.total(F.slice("q", 2, 2)).alias("total")), "total")


_LABELVEC = [("EMAIL", [0.2, 0.9]), ("PHONE", [0.7, -0.1]), ("URL", [-0.5, 0.4])]
_LOGITS = f"v AS (SELECT doc_id, {u('v0', 'doc_id')} x, {u('v1', 'doc_id')} y FROM documents), e AS (SELECT doc_id, [exp(0.2e0 * x + 0.9e0 * y), exp(0.7e0 * x - 0.1e0 * y), exp(-0.5e0 * x + 0.4e0 * y), 1e0] e FROM v)"


def _items(spark, sf):
    d = documents(spark, sf).select("doc_id", F.array(draw("v0"), draw("v1")).alias("vector"), F.lit(0).alias("start"), F.lit(3).alias("end"), draw("pb").alias("pb"))
    return training.label_probabilities(d, rows(spark, _LABELVEC, "label string, vector array<double>"))


@query(f"WITH {_LOGITS} SELECT doc_id, i, round(e[i + 1] / list_sum(e), 6) p FROM e, (SELECT unnest(range(4)) i)")
def label_probabilities(spark, sf):
    return rounded(_items(spark, sf).select("doc_id", F.posexplode("probabilities").alias("i", "p")), "p")


@query(f"""WITH {_LOGITS}, s AS (SELECT doc_id, {u('pb', 'doc_id')} * (1 - e[4] / list_sum(e)) score, ['email', 'phone', 'url'][list_position(e[1:3], list_max(e[1:3]))] w FROM e)
SELECT doc_id, CASE w WHEN 'email' THEN 'EMAIL' WHEN 'phone' THEN 'PHONE' ELSE 'OTHER_PII' END label, upper(w) raw, round(score, 6) score FROM s WHERE score >= 0.3e0""")
def labelled_items(spark, sf):
    return rounded(training.labelled_spans(_items(spark, sf), {"EMAIL": "EMAIL", "PHONE": "PHONE"}, 0.3).select("doc_id", "label", "raw", "score"), "score")


@query(f"SELECT list_sort(list(floor({u('doc', 'doc_id')} * 1000) / 1000))[(floor((count(*) - 1) * 0.1e0) + 1)::INT] threshold FROM documents")
def coverage_threshold(spark, sf):
    """The score that nine tenths of all rows reach."""
    d = documents(spark, sf).select((F.floor(draw("doc") * 1000) / 1000).alias("score"))
    return rows(spark, [(float(calibration.lower_quantile(d, 0.9)),)], "threshold double")


@query(f"""WITH s AS (SELECT floor({u('doc', 'doc_id')} * 98 + 1) / 100 score, CASE WHEN {u('hit', 'doc_id')} < 0.5e0 THEN 1 ELSE 0 END target FROM documents), c AS (SELECT score, target, count(*) k FROM s GROUP BY ALL), t AS (SELECT exp(-3 + 6e0 * unnest(range(20001)) / 20000) t),
l AS (SELECT t, -sum(k * CASE WHEN target = 1 THEN ln(greatest(1e-7, 1 / (1 + exp(-ln(score / (1 - score)) / t)))) ELSE ln(greatest(1e-7, 1 - 1 / (1 + exp(-ln(score / (1 - score)) / t)))) END) l FROM c, t GROUP BY t) SELECT round(ln(arg_min(t, l)), 2) log_t FROM l""")
def fitted_temperature(spark, sf):
    """The temperature of least log loss, to a hundredth of its logarithm."""
    d = documents(spark, sf).select((F.floor(draw("doc") * 98 + 1) / 100).alias("score"), (draw("hit") < 0.5).cast("int").alias("target"))
    return rows(spark, [(calibration.fit_temperature(d),)], "t double").select(F.round(F.log("t"), 2).alias("log_t"))


@query(f"WITH d AS (SELECT lang, floor({u('over', 'doc_id')} * 1000) / 1000 o FROM documents) SELECT lang, max(o) max_over FROM d GROUP BY lang")
def reachable_over(spark, sf):
    return leak.reachable(documents(spark, sf).select("lang", (F.floor(draw("over") * 1000) / 1000).alias("over")), "lang")


# Selections and training rows ----------------------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT doc_id, source label, row_number() OVER (PARTITION BY source ORDER BY sha256('q:' || doc_id), doc_id) r FROM documents) SELECT doc_id FROM l WHERE r <= 3 OR {u('q+', 'doc_id')} < 0.05e0""")
def quota_documents(spark, sf):
    d = documents(spark, sf)
    return training.quota_docs(d, d.select("doc_id", F.col("source").alias("label")), 3, 0.05, "q").select("doc_id")


_SRC = "s AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) n, row_number() OVER (PARTITION BY source ORDER BY sha256('k|' || doc_id), doc_id) r FROM documents)"


@query(f"WITH {_SRC} SELECT doc_id, source FROM s WHERE r <= 5 ORDER BY n, source, r LIMIT 40")
def rarest_first(spark, sf):
    """Five rows a source at most, sources with fewest rows first, forty in all."""
    return training.quota_rows(documents(spark, sf).select("doc_id", "source"), "source", "doc_id", 5, 40, "k")


@query("""WITH d AS (SELECT doc_id, lang kind, 1 + doc_id % 3 m FROM documents), e AS (SELECT doc_id, kind, m, unnest(range(m)) i FROM d), r AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY m DESC, sha256('pr|' || doc_id), doc_id) r FROM e), t AS (SELECT doc_id, kind, r FROM r ORDER BY r, kind LIMIT 24) SELECT kind, doc_id, count(*) n FROM t GROUP BY ALL""")
def probe_rows(spark, sf):
    """Rows of the fullest documents, kinds in turn."""
    d = documents(spark, sf).select("doc_id", F.col("lang").alias("kind"), F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("doc_id") % 3)).alias("i"))
    return training.probe_rows(d, "kind", 24, "pr").groupBy("kind", "doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {SPAN}, h AS (SELECT *, row_number() OVER (ORDER BY sha256('ev|' || doc_id || '|' || "start" || '|' || "end"), doc_id, "start", "end") r FROM span WHERE score < 0.5e0), k AS (SELECT count(*) n FROM span WHERE score >= 0.8e0)
SELECT doc_id, false negative FROM span WHERE score >= 0.8e0 UNION ALL SELECT doc_id, true FROM h, k WHERE r <= n""")
def evaluation_rows(spark, sf):
    """All positives and as many negatives by hash."""
    s = span(spark, sf).select("doc_id", "start", "end", "score")
    return questions.evaluation_questions(s.where("score >= 0.8"), s.where("score < 0.5"), "ev").select("doc_id", "negative")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) nodes FROM documents GROUP BY source")
def source_inventory(spark, sf):
    return training.source_inventory(documents(spark, sf).select("source", F.col("lang").alias("node"))).withColumn("nodes", F.array_join("nodes", ","))


_TOK = "w AS (SELECT label doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 i, embedding e FROM embeddings)"


@query(f"WITH {_TOK} SELECT doc_id::BIGINT doc_id, d, round(avg(e[d + 1]::DOUBLE), 5) mean FROM w, (SELECT unnest(range(64)) d) WHERE i BETWEEN 2 AND 9 GROUP BY ALL")
def span_means(spark, sf):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    t = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("doc_id"), i.alias("i"), F.col("embedding").alias("vector"))
    s = t.select("doc_id").distinct().select("doc_id", F.lit(2).alias("first"), F.lit(9).alias("last"))
    return training.span_means(t, s).select("doc_id", F.posexplode("mean").alias("d", "mean")).withColumn("mean", F.round("mean", 5))


@query(f"""WITH {SPAN}, t AS (SELECT doc_id, unnest(range(greatest("start" // 4 - 2, 0), "start" // 4 + 6)) i, "start" a, "end" b, label FROM span), h AS (SELECT doc_id, i, label, i * 4 < b AND i * 4 + 4 > a hit FROM t), k AS (SELECT doc_id, i, label, min(i) OVER (PARTITION BY doc_id) lo, max(i) OVER (PARTITION BY doc_id) hi FROM h WHERE hit)
SELECT t.doc_id, t.i, CASE WHEN k.i IS NULL THEN 'O' WHEN lo = hi THEN 'S-' || k.label WHEN k.i = lo THEN 'B-' || k.label WHEN k.i = hi THEN 'E-' || k.label ELSE 'I-' || k.label END tag FROM t LEFT JOIN k ON t.doc_id = k.doc_id AND t.i = k.i""")
def token_targets(spark, sf):
    """Tags of tokens of four characters around each span."""
    s = span(spark, sf)
    near = F.expr("start div 4")
    t = s.select("doc_id", F.explode(F.sequence(F.greatest(near - 2, F.lit(0)), near + 5)).alias("i")).select("doc_id", "i", (F.col("i") * 4).cast("int").alias("start"), (F.col("i") * 4 + 4).cast("int").alias("end"))
    return training.token_targets(t, s).select("doc_id", "i", "tag")


@query(f"""WITH {SPAN}, o AS (SELECT doc_id, "start" + 6 a, "start" + 9 b, "start" s, "end" e, label FROM span), n AS (SELECT * FROM o WHERE NOT (a < e AND b > s))
SELECT 'gold' kind, count(*) n FROM span WHERE label <> 'URL' UNION ALL SELECT 'excluded', count(*) FROM span WHERE label = 'URL' UNION ALL SELECT 'negative', count(*) FROM n UNION ALL SELECT 'shift', count(*) FROM span WHERE label <> 'URL'""")
def candidate_items(spark, sf):
    s = span(spark, sf).select("doc_id", "start", "end", "label")
    p = s.select("doc_id", (F.col("start") + 6).alias("start"), (F.col("start") + 9).alias("end"))
    return training.candidate_items(s, s.withColumn("kind", F.lit("shift")), p, rows(spark, [("URL",)], "label string"), 1e9, "n")[1]


@query("""WITH q AS (SELECT lang kind, ['a', 'b', 'none'][(doc_id % 3)::INT + 1] pick, doc_id % 2 = 0 ok FROM documents), t AS (SELECT kind, max(k) / sum(k) top_share FROM (SELECT kind, pick, count(*) k FROM q GROUP BY ALL) GROUP BY kind)
SELECT kind, count(*) n, round(avg(ok::INT), 6) accuracy, round(any_value(top_share), 6) top_share, any_value(top_share) > 0.95 collapsed FROM q JOIN t USING (kind) GROUP BY kind""")
def collapsed_kinds(spark, sf):
    at = F.col("doc_id") % 3
    p = F.array(*[(at == i).cast("double") for i in range(3)])
    d = documents(spark, sf).select(F.col("lang").alias("kind"), F.array(F.lit("a"), F.lit("b"), F.lit("none")).alias("options"), p.alias("probabilities"), F.when(F.col("doc_id") % 2 == 0, at).otherwise(-1).cast("int").alias("target"))
    return rounded(questions.sanity(d).select("kind", "n", "accuracy", "top_share", "collapsed"), "accuracy", "top_share")


@query(f"WITH {_P}, r AS (SELECT doc_id, len([x for x in q if x > q[(doc_id % 3)::INT + 1]]) + 1 r FROM p) SELECT count(*) n, median(r) median_rank, round(avg((r = 1)::INT), 6) top1 FROM r")
def gold_ranks(spark, sf):
    r = vectors.gold_rank(_probs(spark, sf).select("doc_id", F.col("q").alias("scores"), (F.col("doc_id") % 3).cast("int").alias("gold")))
    return rounded(vectors.rank_summary(r), "top1")


_MEANS = "m AS (SELECT label, i, avg(embedding[i]::DOUBLE) x FROM embeddings, (SELECT unnest(range(1, 65)) i) GROUP BY ALL), l AS (SELECT label, list(x ORDER BY i) v FROM m GROUP BY label), n AS (SELECT label, [x / sqrt(list_sum([y * y for y in v])) for x in v] v FROM l)"


@query(f"""WITH {_MEANS}, s AS (SELECT e.vec_id, e.label, n.label id, list_sum([e.embedding[i]::DOUBLE * n.v[i] for i in range(1, 65)]) / sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in e.embedding])) c FROM embeddings e, n), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, id) k FROM s)
SELECT count(DISTINCT vec_id) n, round(avg(a), 6) top1, round(avg(b), 6) top5 FROM (SELECT vec_id, max((id = label AND k = 1)::INT) a, max((id = label AND k <= 5)::INT) b FROM r GROUP BY vec_id)""")
def label_retrieval(spark, sf):
    """How often a vector's own label is the nearest label mean, or among the nearest five."""
    e = table(spark, sf, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("embedding"))
    labels = vectors.with_unit(means).select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("id"), "unit")
    texts = vectors.with_unit(e).select(F.col("vec_id").cast("string").alias("query_id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("label"), "unit")
    return rounded(vectors.retrieval(texts, labels), "top1", "top5")


@query("""WITH r AS (SELECT event_type, event_id, value, quantile_cont(value, 0.95) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) p95 FROM events), l AS (SELECT *, lag(p95) OVER (PARTITION BY event_type ORDER BY event_id) before FROM r)
SELECT event_type, count(*) n, count(*) FILTER (value > 1.2e0 * before) high FROM l GROUP BY event_type""")
def high_batches(spark, sf):
    e = series.high_batches(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_id"], "value", 10, 1.2, "event_type")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("high").alias("high"))


# Decisions -----------------------------------------------------------------------------------------------------------


@query(f"WITH v AS (SELECT doc_id, {u('base', 'doc_id')} b, {u('x', 'doc_id')} x, {u('y', 'doc_id')} y FROM documents) SELECT 'x' variant, round(avg(abs(x - b)), 6) drift FROM v UNION ALL SELECT 'y', round(avg(abs(y - b)), 6) FROM v WHERE doc_id % 2 = 0")
def score_drift(spark, sf):
    """Mean distance of two rewordings from the base wording; one covers half of the rows."""
    d = documents(spark, sf).select("doc_id")
    part = lambda name, salt, rows_: rows_.select(F.lit(name).alias("variant"), F.col("doc_id").alias("key"), draw(salt).alias("score"))
    return rounded(stats.drift(part("base", "base", d).unionByName(part("x", "x", d)).unionByName(part("y", "y", d.where("doc_id % 2 = 0"))), "base"), "drift")


# Diagnostics ---------------------------------------------------------------------------------------------------------

# Predictions beside the drawn spans: four in five, one in ten of them moved, one in five mistyped.
GUESS = f"""{SPAN}, guess AS (SELECT doc_id, "start" + CASE WHEN {u('move', 'doc_id')} < 0.1e0 THEN 2 ELSE 0 END AS "start", "end", CASE WHEN {u('wrong', 'doc_id')} < 0.2e0 THEN 'URL' ELSE label END label, floor({u('how', 'doc_id')} * 1000) / 1000 score FROM span WHERE {u('there', 'doc_id')} < 0.8e0)"""


def guess(spark: SparkSession, sf: str) -> DataFrame:
    s = span(spark, sf).where(draw("there") < 0.8)
    moved = (F.col("start") + F.when(draw("move") < 0.1, 2).otherwise(0)).cast("int")
    return s.select("doc_id", moved.alias("start"), "end", F.when(draw("wrong") < 0.2, "URL").otherwise(F.col("label")).alias("label"), (F.floor(draw("how") * 1000) / 1000).alias("score"))


_EXACT = f'{GUESS}, x AS (SELECT s.*, g.label said, g.score how, g.doc_id IS NOT NULL hit FROM span s LEFT JOIN guess g ON s.doc_id = g.doc_id AND s."start" = g."start" AND s."end" = g."end")'


@query(f"WITH {_EXACT} SELECT count(*) n, count(*) FILTER (how >= 0.3e0) found, round(count(*) FILTER (how >= 0.3e0) / count(*), 6) recall FROM x")
def boundary_recall(spark, sf):
    return rounded(diagnostics.boundary_recall(guess(spark, sf), span(spark, sf), 0.3), "recall")


@query(f'WITH {_EXACT} SELECT label, count(*) n, count(said) matched, count(*) FILTER (said = label) "right", round(count(*) FILTER (said = label) / count(said), 6) accuracy FROM x GROUP BY label')
def typing_by_label(spark, sf):
    return rounded(diagnostics.typing_by_label(guess(spark, sf), span(spark, sf)), "accuracy")


@query(f"WITH {_EXACT}, l AS (SELECT label, count(*) FILTER (said = label) / count(said) a FROM x GROUP BY label HAVING count(*) >= 5 AND count(said) > 0) SELECT count(*) labels, round(avg(a), 6) macro FROM l")
def macro_typing(spark, sf):
    """Mean over labels with five spans or more."""
    return rounded(diagnostics.macro(diagnostics.typing_by_label(guess(spark, sf), span(spark, sf), 5)), "macro")


@query(f"WITH {_EXACT} SELECT count(*) n, count(*) FILTER (hit) found, round(count(*) FILTER (hit) / count(*), 6) recall, count(*) FILTER (hit) / count(*) >= 0.7e0 passed FROM x")
def candidate_gate(spark, sf):
    return rounded(diagnostics.candidate_gate(guess(spark, sf), span(spark, sf), 64, 0.7), "recall")


@query(f'WITH {GUESS}, c AS (SELECT s.*, g."start" gs FROM span s LEFT JOIN guess g USING (doc_id)) SELECT sum("end" - "start")::BIGINT chars, sum(CASE WHEN gs IS NULL THEN 0 ELSE "end" - gs END)::BIGINT covered, round(sum(CASE WHEN gs IS NULL THEN 0 ELSE "end" - gs END) / sum("end" - "start"), 6) recall FROM c')
def proposer_ceiling(spark, sf):
    """Gold characters under any prediction."""
    return rounded(diagnostics.covered_chars(guess(spark, sf), span(spark, sf)), "recall")


_ERR = f"""{_EXACT}, e AS (SELECT x.*, CASE WHEN hit THEN 'matched' WHEN doc_id IN (SELECT doc_id FROM guess) THEN 'overlap' ELSE 'absent' END kind, CASE WHEN "end" - "start" <= 6 THEN 'short' WHEN "end" - "start" <= 10 THEN 'middle' ELSE 'long' END size FROM x)"""


@query(f'WITH {_ERR} SELECT size, kind, count(*) n, count(*) FILTER (said = label) "right" FROM e GROUP BY ALL')
def error_kinds(spark, sf):
    return diagnostics.error_summary(diagnostics.errors(guess(spark, sf), span(spark, sf)))


@query(f'WITH {_ERR}, c AS (SELECT label, said, count(*) n FROM e WHERE said <> label GROUP BY ALL) SELECT label, said, n, row_number() OVER (ORDER BY n DESC, label, said) "rank" FROM c QUALIFY row_number() OVER (ORDER BY n DESC, label, said) <= 12')
def confusions(spark, sf):
    return diagnostics.confusions(diagnostics.errors(guess(spark, sf), span(spark, sf)))


_PICK = f"{_P}, a AS (SELECT doc_id, q, list_position(q, list_max(q)) - 1 pick, doc_id % 3 target FROM p)"


def _answers(spark, sf):
    return _probs(spark, sf).select("doc_id", F.col("q").alias("probabilities"), (F.col("doc_id") % 3).cast("int").alias("target"))


@query(f"WITH {_PICK} SELECT count(*) n, round(avg((pick = target)::INT) FILTER (target <> 2), 6) gold_accuracy, round(avg((pick = target)::INT) FILTER (target = 2), 6) none_accuracy, round(avg((pick = 2)::INT), 6) none_rate, round(avg(list_max(q)), 6) mean_top FROM a")
def answer_summary(spark, sf):
    return rounded(diagnostics.answer_summary(_answers(spark, sf), 2), "gold_accuracy", "none_accuracy", "none_rate", "mean_top")


@query(f'WITH {_PICK}, c AS (SELECT pick::BIGINT pick, count(*) n FROM a GROUP BY pick) SELECT pick, n, row_number() OVER (ORDER BY n DESC, pick) "rank" FROM c')
def top_picks(spark, sf):
    return diagnostics.top_picks(_answers(spark, sf))


_GRID = (-1.0, -0.5, 0.0, 0.5, 1.0)


@query(f"""WITH {_PICK}, g AS (SELECT unnest({list(_GRID)!r})::DOUBLE o), m AS (SELECT doc_id % 2 fold, o, target, [ln(q[1]), ln(q[2]), ln(q[3]) + o] l FROM a, g), c AS (SELECT fold, o, avg((list_position(l, list_max(l)) - 1 = target)::INT) acc FROM m GROUP BY ALL),
b AS (SELECT fold, arg_max(o, (acc, -abs(o), -o)) o FROM c GROUP BY fold) SELECT (1 - b.fold)::BIGINT test_fold, b.o AS "offset", round(z.acc, 6) AS "before", round(t.acc, 6) AS "after" FROM b JOIN c t ON t.fold = 1 - b.fold AND t.o = b.o JOIN c z ON z.fold = 1 - b.fold AND z.o = 0""")
def prior_corrections(spark, sf):
    return rounded(diagnostics.prior_correction(_answers(spark, sf), F.col("doc_id") % 2, 2, list(_GRID)), "before", "after")


@query(f"""WITH {_MEANS}, h AS (SELECT label, label % 3 node, v FROM n WHERE label < 3), t AS (SELECT label, label % 3 node, v FROM n WHERE label >= 3), s AS (SELECT h.label, t.label tl, t.node <> h.node other, list_sum([h.v[i] * t.v[i] for i in range(1, 65)]) c FROM h, t)
SELECT 'label' || label label, count(*) FILTER (NOT other) same_node, count(*) FILTER (other) remaining, 'label' || arg_max(tl, c) FILTER (other) nearest, round(max(c) FILTER (other), 6) cosine FROM s GROUP BY label""")
def neighbour_audit(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = vectors.with_unit(e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("embedding")))
    m = m.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("label"), (F.col("label") % 3).alias("node"), "unit", F.col("label").alias("k"))
    return rounded(diagnostics.neighbour_audit(m.where("k < 3"), m.where("k >= 3")), "cosine")


@query(f"""WITH d AS (SELECT lang dataset, avg({u('sa', 'doc_id')}) a, avg({u('sb', 'doc_id')}) b FROM documents GROUP BY lang), s AS (SELECT 'a' system, dataset, round(a, 6) pauc FROM d UNION ALL SELECT 'b', dataset, round(b, 6) FROM d) SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pauc, system) place FROM s""")
def scoreboard(spark, sf):
    d = documents(spark, sf)
    return diagnostics.scoreboard({s: rounded(d.groupBy(F.col("lang").alias("dataset")).agg(F.avg(draw("s" + s)).alias("pauc")), "pauc") for s in ("a", "b")}, "pauc")


@query(f"""WITH h AS (SELECT floor({u('ch', 'doc_id')} * 200) / 200 score, n_chars % 7 pii, n_chars % 7 + n_chars % 11 n FROM documents), c AS (SELECT score, unnest(range(n)) i, pii FROM h), e AS (SELECT quantile_cont(score, {[i / 15 for i in range(1, 15)]!r}) q FROM c),
b AS (SELECT len([x for x in q if x <= score]) b, score, i < pii y FROM c, e), g AS (SELECT b, count(*) k, avg(score) p, avg(y::INT) y FROM b GROUP BY b) SELECT round(sum(k * abs(p - y)) / sum(k), 6) ece FROM g""")
def char_ece(spark, sf):
    h = documents(spark, sf).select((F.floor(draw("ch") * 200) / 200).alias("score"), (F.col("n_chars") % 7).alias("n_pii"), (F.col("n_chars") % 11).alias("n_non"))
    return rounded(diagnostics.char_ece(h), "ece")


@query("SELECT 'done' AS state, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents")
def result_round_trip(spark, sf):
    """A result written as JSON over an older one and read again."""
    at = folder(spark, "result")
    r = documents(spark, sf).agg(F.count("*"), F.sum("n_chars")).first()
    sinks.write_result(spark, {"state": "begun"}, at)
    sinks.write_result(spark, {"state": "done", "n": r[0], "chars": r[1]}, at)
    back = sinks.read_result(spark, at)
    return rows(spark, [(back["state"], back["n"], back["chars"])], "state string, n long, chars long")
