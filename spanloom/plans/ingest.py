"""Registered queries of sources and stores: corpus recipes, seeded conversations, stores that are taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import prob
from spanloom.operators import taxonomy
from spanloom.plans.catalog import query
from spanloom.plans.coverage import folder
from spanloom.plans.demo import documents, u
from spanloom.session import table
from spanloom.sources import grammar, recipes, sinks

_BROKEN = "{broken"


def _lines(records: DataFrame, at: str) -> str:
    """Records as JSON lines, with a broken line for every tenth document."""
    good = records.select(F.to_json(F.struct(*[c for c in records.columns if c != "_n"])).alias("value"))
    bad = records.where("_n % 10 = 0").select(F.lit(_BROKEN).alias("value"))
    good.unionByName(bad).write.mode("overwrite").text(at)
    return at


def _spans(docs: DataFrame, aside: DataFrame) -> DataFrame:
    """A row a span, and one a kind of fault."""
    s = docs.select("doc_id", "cluster_id", F.explode("spans").alias("s")).select("doc_id", "cluster_id", "s.start", "s.end", "s.label", "s.surface")
    f = aside.groupBy("fault").count().select(F.lit("aside").alias("doc_id"), F.col("fault").alias("cluster_id"), F.col("count").cast("int").alias("start"), F.lit(0).alias("end"), F.lit("").alias("label"), F.lit("").alias("surface"))
    return s.unionByName(f)


_ASIDE = """SELECT 'aside', 'no JSON', count(*), 0, '', '' FROM documents WHERE doc_id % 10 = 0 HAVING count(*) > 0"""
_WORD = r"regexp_extract(text, '[A-Za-z]+')"


def _first_word(spark, sf) -> DataFrame:
    """Documents with the first run of letters and its place."""
    w = F.regexp_extract("text", "[A-Za-z]+", 0)
    return documents(spark, sf).where(w != "").withColumn("w", w).withColumn("at", F.instr("text", w) - 1)


@query(f"""SELECT 'nemotron_' || doc_id || '-' || lang doc_id, 'nemotron:' || source || '|note' cluster_id, instr(text, w) - 1 AS "start", instr(text, w) - 1 + length(w) AS "end", 'name' label, w surface FROM (SELECT *, {_WORD} w FROM documents WHERE {_WORD} <> '') UNION ALL {_ASIDE}
UNION ALL SELECT 'aside', 'lacks text', count(*), 0, '', '' FROM documents WHERE NOT regexp_matches(text, '[A-Za-z]') HAVING count(*) > 0""")
def recipe_json_spans(spark, sf):
    """Records with spans as JSON text, upper case folded to the slice; documents without letters lack their text."""
    d = _first_word(spark, sf)
    one = F.to_json(F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.length("w")).alias("end"), F.lit("name").alias("label"), F.upper("w").alias("text"))))
    some = d.select(F.col("doc_id").alias("_n"), F.col("doc_id").cast("string").alias("uid"), F.col("lang").alias("locale"), F.col("source").alias("domain"), F.lit("note").alias("document_type"), "text", one.alias("spans"))
    rest = documents(spark, sf).join(d.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("_n"), F.col("doc_id").cast("string").alias("uid"), F.lit(None).cast("string").alias("text"))
    return _spans(*recipes.recipe(spark, "nemotron", _lines(some.unionByName(rest, allowMissingColumns=True), folder(spark, "nemotron"))))


@query(f"""SELECT doc_id::VARCHAR doc_id, doc_id::VARCHAR cluster_id, instr(text, w) - 1 AS "start", instr(text, w) - 1 + length(w) AS "end", CASE WHEN doc_id % 2 = 0 THEN 'PERSON/DIRECT' ELSE 'LOC/QUASI' END label, CASE WHEN doc_id % 2 = 0 THEN 'PERSON' ELSE 'IGNORE' END canonical, w surface FROM (SELECT *, {_WORD} w FROM documents WHERE {_WORD} <> '')""")
def recipe_court_cases(spark, sf):
    """Files of JSON arrays, a file a language."""
    d = _first_word(spark, sf)
    even = F.col("doc_id") % 2 == 0
    m = F.struct(F.col("at").alias("start_offset"), (F.col("at") + F.length("w")).alias("end_offset"), F.col("w").alias("span_text"), F.when(even, "PERSON").otherwise("LOC").alias("entity_type"), F.when(even, "DIRECT").otherwise("QUASI").alias("identifier_type"))
    record = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "text", F.create_map(F.lit("ann"), F.struct(F.array(m).alias("entity_mentions"))).alias("annotations"))
    at = folder(spark, "court")
    # a record is one of many of its file's array: 64 files by hash
    files = d.select(F.pmod("doc_id", F.lit(64)).alias("file"), F.to_json(record).alias("r")).groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("r")), ","), F.lit("]")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).mode("overwrite").text(at)
    docs, _ = recipes.recipe(spark, "tab_direct", at)
    s = docs.select("doc_id", "cluster_id", F.explode("spans").alias("s")).select("doc_id", "cluster_id", "s.start", "s.end", "s.label", "s.surface")
    part = F.split("label", "/")
    return s.withColumn("canonical", taxonomy.court_label(part[0], part[1]))


@query(rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') AND NOT contains(text, '{{') AND NOT contains(text, '}}'))
SELECT 'spy_medical_' || doc_id doc_id, 'spy_medical_' || doc_id cluster_id, 0::BIGINT AS "start", length(w[1])::BIGINT AS "end", 'MARK' label, w[1] surface FROM t UNION ALL SELECT 'aside', 'no JSON', count(*), 0, '', '' FROM t WHERE doc_id % 10 = 0 HAVING count(*) > 0""")
def recipe_tokens(spark, sf):
    """Token records whose first token is tagged."""
    w = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    d = documents(spark, sf).where("not contains(text, '{') and not contains(text, '}')").select("doc_id", w.alias("tokens")).where(F.size("tokens") > 0)
    d = d.select(F.col("doc_id").alias("_n"), F.col("doc_id").cast("string").alias("doc_id"), "tokens", F.transform("tokens", lambda x: F.lit(True)).alias("trailing_whitespace"), F.transform("tokens", lambda x, i: F.when(i == 0, "B-MARK").otherwise("O")).alias("ent_tags"))
    return _spans(*recipes.recipe(spark, "spy_medical", _lines(d, folder(spark, "spy"))))


@query("""WITH m AS (SELECT conv_id, turn, role, text, CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END prefix, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END o FROM conversations WHERE text IS NOT NULL AND role IN ('system', 'user', 'assistant')),
p AS (SELECT *, coalesce(sum(length(prefix) + length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, o, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(prefix) base FROM m)
SELECT 'pii_trace_' || conv_id doc_id, conv_id::VARCHAR cluster_id, base::BIGINT AS "start", (base + 3)::BIGINT AS "end", 'other' label, substr(text, 1, 3) surface FROM p WHERE role = 'user' AND length(text) >= 3""")
def recipe_conversations(spark, sf):
    """Conversations with spans by message, moved to offsets in the whole."""
    t = table(spark, sf, "conversations").where("text is not null").withColumn("conv_id", F.col("conv_id").cast("string")).withColumn("turn", F.col("turn").cast("int"))
    spans = F.filter(F.collect_list(F.when((F.col("role") == "user") & (F.length("text") >= 3), F.struct("turn", "role", F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("other").alias("label"), F.substring("text", 1, 3).alias("surface")))), lambda x: x.isNotNull())
    d = t.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("messages"), spans.alias("spans"))
    d.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(at := folder(spark, "trace"))
    docs, _ = recipes.recipe(spark, "pii_trace", at)
    return docs.select("doc_id", "cluster_id", F.explode("spans").alias("s")).select("doc_id", "cluster_id", "s.start", "s.end", "s.label", "s.surface")


# Seeded conversations ------------------------------------------------------------------------------------------------

SALT = "desk-1"


def _number(what: str, n: int) -> str:
    return f"least({n - 1}, floor({u(f'{SALT}:{what}', 'conv_id')} * {n}))::BIGINT"


def _digits(what: str, k: int) -> str:
    return f"substr({' || '.join(f'''lpad(({_number(f'{what}{i}', 10_000)})::VARCHAR, 4, '0')''' for i in range(-(-k // 4)))}, 1, {k})"


def _one(what: str, of: tuple[str, ...]) -> str:
    return f"([{', '.join(repr(x) for x in of)}])[({_number(what, len(of))}) + 1]"


def _said(x: str) -> str:
    return f"array_to_string([CASE WHEN i % 4 = 0 THEN 'uh ' ELSE '' END || (['zero','one','two','three','four','five','six','seven','eight','nine'])[substr({x}, i::INT, 1)::INT + 1] for i in range(1, length({x}) + 1)], ' ')"


def _grammar_sql() -> str:
    """The same productions: draws, then slots, then parts by kind and channel, then running offsets."""
    total, upto, kinds = sum(w for w, *_ in grammar.TEMPLATES.values()), 0, []
    for k, (w, *_) in grammar.TEMPLATES.items():
        upto += w
        kinds.append(f"WHEN {u(f'{SALT}:kind', 'conv_id')} < {upto / total!r}::DOUBLE THEN '{k}'")
    slots = {"greet": "greet", "first": "first", "name": "first || ' ' || last", "card": "card", "last4": "substr(card, 13, 4)", "last4_said": _said("substr(card, 13, 4)"), "card_a_said": _said("substr(card, 1, 8)"), "card_b_said": _said("substr(card, 9, 8)"),
             "code": "code", "code_said": _said("code"), "account": "account", "account_said": _said("account"), "phone": "'+1 202 555 ' || phone", "phone_said": _said("('202555' || phone)"), "email": "user || '@example.com'", "url": "'https://example.org/' || user", "user": "user",
             "street": f"(({_number('house', 300)}) + 1)::VARCHAR || ' ' || {_one('street', grammar.STREETS)}", "secret": f"'pw-' || {_digits('secret', 8)}", "ip": " || '.' || ".join(f"({_number(f'ip{i}', 256)})::VARCHAR" for i in range(4)),
             "born": f"(({_number('year', 66)}) + 1940)::VARCHAR || '-' || lpad((({_number('month', 12)}) + 1)::VARCHAR, 2, '0') || '-' || lpad((({_number('day', 28)}) + 1)::VARCHAR, 2, '0')", "hour": f"(({_number('hour', 9)}) + 1)::VARCHAR", "n": f"(({_number('n', 8)}) + 2)::VARCHAR"}
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = " ".join(f"WHEN kind = '{k}' AND spoken = {spoken} THEN [" + ", ".join(f"{{'t': {slots[x] if slot else quoted(x)}, 'l': {repr(label) if label else 'NULL'}}}" for x, label, slot in grammar.parts(t)) + "]" for k, (_, typed, said) in grammar.TEMPLATES.items() for spoken, t in (("false", typed), ("true", said)))
    check = "(10 - (list_sum([CASE WHEN i % 2 = 1 THEN (2 * substr(raw, i::INT, 1)::INT) % 10 + (2 * substr(raw, i::INT, 1)::INT) // 10 ELSE substr(raw, i::INT, 1)::INT END for i in range(1, 16)]) % 10)) % 10"
    return f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations),
d AS (SELECT conv_id, CASE {' '.join(kinds)} ELSE 'decoy' END kind, {u(f'{SALT}:channel', 'conv_id')} < {grammar.SPOKEN}e0 spoken, {_one('greet', grammar.GREETINGS)} greet, {_one('first', grammar.FIRST)} first, {_one('last', grammar.LAST)} last, '4' || {_digits('card', 14)} raw, {_digits('code', 3)} code, {_digits('account', 10)} account, {_digits('phone', 4)} phone, lower({_one('first', grammar.FIRST)}) || ({_number('user', 900)})::VARCHAR AS user FROM c),
e AS (SELECT *, raw || ({check})::VARCHAR card FROM d), f AS (SELECT conv_id, kind, spoken, CASE {rows} END p FROM e),
g AS (SELECT conv_id, kind || ':' || CASE WHEN spoken THEN 'spoken' ELSE 'typed' END cluster_id, unnest(p) x, unnest(range(len(p))) i FROM f),
h AS (SELECT conv_id, cluster_id, x.t t, x.l l, i, coalesce(sum(length(x.t)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) a FROM g)
SELECT 'synth_' || conv_id doc_id, cluster_id, md5(string_agg(t, '' ORDER BY i)) digest, coalesce(string_agg(a || ':' || (a + length(t)) || ':' || l || ':' || t, ';' ORDER BY i) FILTER (l IS NOT NULL), '') spans FROM h GROUP BY conv_id, cluster_id"""


@query(_grammar_sql())
def synthetic_conversations(spark, sf):
    """A dialogue for each conversation's id."""
    d = grammar.expand(table(spark, sf, "conversations").select("conv_id").distinct(), "conv_id", SALT)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["label"], s["surface"])), ";")
    return d.select("doc_id", "cluster_id", F.md5(F.col("text").cast("binary")).alias("digest"), spans.alias("spans"))


# A store that is taken up again --------------------------------------------------------------------------------------


@query(f"SELECT source, count(*) n, sum(length(text))::BIGINT chars, round(sum({u('store', 'doc_id')}), 6) draws, (SELECT count(*) FROM (SELECT 1 FROM documents HAVING count(*) > 0)) again FROM documents GROUP BY source")
def resumed_store(spark, sf):
    """Features of all documents, written in two goes: the first stops after one language, the third finds nothing to do."""
    at, d = folder(spark, "resumed"), documents(spark, sf).select("doc_id", "source", "lang", "text")
    features = lambda x: x.select("doc_id", "source", F.length("text").alias("chars"), prob.unit("store", F.col("doc_id")).alias("draw"))
    sinks.write_store(d.where("lang = 'en'"), at, "doc_id", features, "v1")
    sinks.write_store(d, at, "doc_id", features, "v1")
    again = sinks.write_store(d, at, "doc_id", features, "v1")
    got = sinks.read_store(spark, at).groupBy("source").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.round(F.sum("draw"), 6).alias("draws"))
    return got.withColumn("again", F.lit(1 + len(again)))
