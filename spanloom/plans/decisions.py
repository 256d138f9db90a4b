"""Registered queries of dimensions, ledgers, gates and decisions, on rows that are aggregated from documents."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import prob, text
from spanloom.operators import questions, runs, stats, taxonomy, vectors
from spanloom.plans.catalog import query, rounded, values
from spanloom.plans.coverage import _NATIVE, draw, folder, rows
from spanloom.plans.demo import documents, named, u
from spanloom.sources import readers, sinks


def cells(spark, sf, *by) -> DataFrame:
    """Documents counted by language and source."""
    return documents(spark, sf).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_CELLS = "cells AS (SELECT lang, source, count(*) n, sum(length(text))::BIGINT chars FROM documents GROUP BY ALL)"
_LANGS = "langs AS (SELECT lang, count(*) n, sum(length(text))::BIGINT chars FROM documents GROUP BY ALL)"


def langs(spark, sf) -> DataFrame:
    return documents(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# Hierarchies and vocabularies ----------------------------------------------------------------------------------------

_TREE = "tree AS (SELECT 'all' node, NULL::VARCHAR parent UNION SELECT lang, 'all' FROM documents UNION SELECT lang || '/' || source, lang FROM documents), closure AS (SELECT node, node ancestor, 0 AS depth FROM tree UNION ALL SELECT c.node, t.parent, c.depth + 1 FROM closure c JOIN tree t ON t.node = c.ancestor WHERE t.parent IS NOT NULL)"


def _tree(spark, sf) -> DataFrame:
    """All documents, under them languages, under these their sources."""
    d = documents(spark, sf).select("lang", "source").distinct()
    low = d.select(F.concat_ws("/", "lang", "source").alias("node"), F.col("lang").alias("parent"))
    return low.unionByName(d.select(F.col("lang").alias("node"), F.lit("all").alias("parent")).distinct()).unionByName(rows(spark, [("all", None)], "node string, parent string"))


@query(f"WITH RECURSIVE {_TREE} SELECT node, ancestor, depth::BIGINT depth FROM closure")
def label_closure(spark, sf):
    return taxonomy.label_closure(_tree(spark, sf))


@query(f"WITH RECURSIVE {_TREE}, p AS (SELECT node a, ancestor b FROM closure) SELECT a, b FROM p UNION SELECT b, a FROM p")
def compatible_nodes(spark, sf):
    tree = _tree(spark, sf)
    return taxonomy.compatible_pairs(tree.select(F.col("node").alias("raw"), "node"), taxonomy.label_closure(tree))


_RAWS = f"d AS (SELECT doc_id, lang, (SELECT list(raw ORDER BY raw) FROM {values(_NATIVE, 'raw', 'node')} l) raws FROM documents), said AS (SELECT doc_id, lang, raws[least(len(raws) - 1, floor({u('raw', 'doc_id')} * len(raws)))::INT + 1] raw FROM d)"


def _said(spark, sf) -> DataFrame:
    """A raw label for each document, drawn from all that are known."""
    names = tuple(sorted(r for r, _ in _NATIVE))
    return documents(spark, sf).select("doc_id", "lang", named(F.least(F.lit(len(names) - 1), F.floor(draw("raw") * len(names))), names).alias("raw"))


@query(f"WITH {_RAWS} SELECT said.raw, node, count(*) n FROM said JOIN {values(_NATIVE, 'raw', 'node')} l ON l.raw = said.raw GROUP BY ALL")
def native_labels(spark, sf):
    """The node of each label that documents are given."""
    return _said(spark, sf).join(F.broadcast(taxonomy.native_labels(spark)), "raw").groupBy("raw", "node").agg(F.count("*").alias("n"))


@query(f"WITH {_RAWS} SELECT DISTINCT raw, replace(raw, '_', ' ') || CASE WHEN length(raw) % 2 = 0 THEN ': ' || lang ELSE '' END shown, replace(lower(trim(' ' || raw || ' ')), '_', ' ') plain FROM said")
def label_texts(spark, sf):
    n = _said(spark, sf).select("raw", "lang").distinct()
    return n.select("raw", text.label_text(F.col("raw"), F.when(F.length("raw") % 2 == 0, F.col("lang")).otherwise("")).alias("shown"), text.raw_label(F.concat(F.lit(" "), "raw", F.lit(" "))).alias("plain")).distinct()


@query(f"""WITH {_RAWS}, l AS (SELECT DISTINCT raw, lang AS node FROM said WHERE doc_id % 3 > 0), h AS (SELECT DISTINCT raw, lang || raw AS node FROM said WHERE {u('held', 'doc_id')} < 0.1e0), p AS (SELECT raw, upper(replace(raw, '_', ' ')) txt FROM said WHERE {u('held', 'doc_id')} < 0.05e0)
SELECT DISTINCT raw FROM l WHERE raw IN (SELECT raw FROM h) OR node IN (SELECT node FROM h) OR replace(raw, '_', ' ') IN (SELECT lower(txt) FROM p WHERE raw IN (SELECT raw FROM h))""")
def excluded_labels(spark, sf):
    s = _said(spark, sf)
    held = s.where(draw("held") < 0.1).select("raw", F.concat("lang", "raw").alias("node")).distinct()
    said = s.where(draw("held") < 0.05).select("raw", F.upper(F.replace("raw", F.lit("_"), F.lit(" "))).alias("text"))
    return taxonomy.excluded_labels(s.where("doc_id % 3 > 0").select("raw", F.col("lang").alias("node")).distinct(), held, said)


@query(f"WITH {_RAWS} SELECT raw FROM said WHERE lang = 'en' INTERSECT SELECT raw FROM said WHERE lang = 'de' EXCEPT SELECT raw FROM said WHERE {u('out', 'doc_id')} < 0.1e0 EXCEPT SELECT raw FROM said WHERE lang = 'fr' AND length(raw) > 8")
def training_vocabulary(spark, sf):
    """Labels given in two languages, but for drawn ones and the long ones of a third."""
    s = _said(spark, sf)
    return taxonomy.training_vocabulary(s.where("lang = 'en'"), s.where("lang = 'de'"), s.where(draw("out") < 0.1), s.where("lang = 'fr'").where(F.length("raw") > 8))


@query(f"WITH g AS (SELECT source label, {u('best', 'source')} best, count(*) support FROM documents GROUP BY source) SELECT label, row_number() OVER (ORDER BY best, label) AS \"rank\" FROM g WHERE support >= 5 AND label NOT IN ('web0', 'books') QUALIFY row_number() OVER (ORDER BY best, label) <= 3")
def chosen_held_out(spark, sf):
    g = documents(spark, sf).groupBy(F.col("source").alias("label")).agg(F.count("*").alias("support")).withColumn("best", draw("best", "label"))
    return vectors.choose_held_out(g, 5, ["web0", "books"], 3).select("label", "rank")


# Files, ledgers and runs ---------------------------------------------------------------------------------------------


@query("SELECT DISTINCT source system, '/data/' || lang || '.jsonl' docs_key, source || '-' || lang AS path FROM documents")
def prediction_files(spark, sf):
    """Headers with several ways to write a path, one for each source and language."""
    way = F.when(F.length("source") % 2 == 0, "file:///data/").otherwise("/data/")
    return readers.prediction_index(cells(spark, sf).select(F.col("source").alias("system"), F.concat(way, "lang", F.lit(".jsonl")).alias("docs_path"), F.concat_ws("-", "source", "lang").alias("path")))


@query(f"WITH {_LANGS} SELECT lang AS stage, round(chars / 1e6, 3) AS hours, CASE WHEN n % 2 = 0 THEN 'done' ELSE 'failed' END status, n % 3 = 0 headline FROM langs")
def ledger_export(spark, sf):
    """A ledger row a language, appended one by one and exported as flat columns."""
    at, out = folder(spark, "ledger"), folder(spark, "flat")
    for r in langs(spark, sf).collect():
        sinks.append_ledger(spark, at, {"stage": r.lang, "hours": r.chars / 1e6, "status": "done" if r.n % 2 == 0 else "failed"}, headline=r.n % 3 == 0, revision="abc123")
    sinks.export_flat(sinks.read_ledger(spark, at), {"stage": "$.stage", "hours": "$.hours", "status": "$.status"}, out)
    return spark.read.parquet(out).select("stage", F.round(F.col("hours").cast("double"), 3).alias("hours"), "status", "headline")


_HALVES = "halves AS (SELECT lang, doc_id % 2 half, count(*) n, sum(length(text))::BIGINT chars FROM documents GROUP BY ALL)"


def _halves(spark, sf) -> list:
    return documents(spark, sf).groupBy("lang", (F.col("doc_id") % 2).alias("half")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy("lang", "half").collect()


@query(f"WITH {_HALVES} SELECT lang AS stage, round(sum(chars) / 1e6, 3) AS hours FROM halves GROUP BY lang")
def stage_hours(spark, sf):
    at = folder(spark, "ledger")
    for r in _halves(spark, sf):
        sinks.append_ledger(spark, at, {"stage": r.lang, "hours": r.chars / 1e6})
    return rounded(runs.hours(sinks.read_ledger(spark, at)), "hours").withColumn("hours", F.round("hours", 3))


@query(f"WITH {_HALVES} SELECT lang || half unit FROM halves WHERE n % 5 > 0 AND n % 3 > 0 AND n % 2 = 0")
def current_units(spark, sf):
    """Units done under the wanted version and inputs, with all their rows."""
    at = folder(spark, "ledger")
    for r in _halves(spark, sf):
        sinks.append_ledger(spark, at, {"unit": f"{r.lang}{r.half}", "status": "done" if r.n % 5 else "failed", "key": "k" if r.n % 3 else "old", "rows": r.n, "expected": r.n + r.n % 2})
    return runs.current(sinks.read_ledger(spark, at), sinks.VERSION, "k")


@query(f"WITH {_LANGS}, a AS (SELECT *, row_number() OVER (ORDER BY lang) i FROM langs) SELECT lang unit, i <= 2 first, i > 2 again, n FROM a")
def resumed_units(spark, sf):
    """A run of a unit a language that is stopped after two goes on with the others."""
    at, d = folder(spark, "ledger"), documents(spark, sf)
    names = sorted(r.lang for r in d.select("lang").distinct().collect())
    done: dict[str, int] = {}

    def unit(name: str):
        def f() -> int:
            done[name] = d.where(F.col("lang") == name).count()
            return done[name]

        return f

    units = {n: unit(n) for n in names}
    first = runs.run_units(spark, at, "count", units, "k", sinks.VERSION, 10.0, stop=lambda: len(done) >= 2)
    again = runs.run_units(spark, at, "count", units, "k", sinks.VERSION, 10.0)
    return rows(spark, [(n, n in first, n in again, done[n]) for n in names], "unit string, first boolean, again boolean, n long")


@query(f"WITH {_LANGS} SELECT lang, n AS quota, true pinned FROM langs")
def checked_config(spark, sf):
    """A configuration written, pinned by its hash, and read again."""
    at = folder(spark, "config")
    quotas = {r.lang: r.n for r in langs(spark, sf).collect()}
    said = json.dumps(quotas, sort_keys=True)
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(at)
    path = readers.checked_file(spark, at, hashlib.sha256((said + "\n").encode()).hexdigest())
    return rows(spark, [(k, int(v), True) for k, v in readers.json_config(spark, path).items()], "lang string, quota long, pinned boolean")


@query(f"""WITH g AS (SELECT source name, list(DISTINCT lang) FILTER (doc_id % 7 = 0) purposes, count(*) n FROM documents GROUP BY source) SELECT name, 'en' AS purpose, coalesce(list_contains(purposes, 'en'), false) AND n % 5 > 0 allowed FROM g UNION ALL SELECT 'missing', 'en', false""")
def licence_decisions(spark, sf):
    """Sources whose manifest entry allows English, some for research alone."""
    m = documents(spark, sf).groupBy(F.col("source").alias("name")).agg(F.collect_set(F.when(F.col("doc_id") % 7 == 0, F.col("lang"))).alias("purposes"), F.count("*").alias("n"))
    m = m.select("name", "purposes", (F.col("n") % 5 == 0).alias("research_only")).cache()
    out = []
    for name in [r.name for r in m.select("name").collect()] + ["missing"]:
        try:
            taxonomy.licence_gate(m, name, "en", allow="SPANLOOM_UNSET")
            out.append((name, "en", True))
        except PermissionError:
            out.append((name, "en", False))
    return rows(spark, out, "name string, purpose string, allowed boolean")


_SHA = "substr(sha256(lang || n), 1, 8)"
_SYSTEMS = f"{_CELLS}, r AS (SELECT lang AS system, 'd' || (n % 4) dataset, {_SHA} weights_sha, min({u('pauc', 'lang', 'source')}) pauc FROM cells GROUP BY ALL), m AS (SELECT DISTINCT system, weights_sha FROM r WHERE ('0x' || substr(weights_sha, 1, 1))::INT < 12)"


def _systems(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = cells(spark, sf).withColumn("weights_sha", F.substring(F.sha2(F.concat("lang", F.col("n").cast("string")), 256), 1, 8))
    r = c.groupBy(F.col("lang").alias("system"), F.concat(F.lit("d"), (F.col("n") % 4).cast("string")).alias("dataset"), "weights_sha").agg(F.min(draw("pauc", "lang", "source")).alias("pauc"))
    return r, r.where(F.conv(F.substring("weights_sha", 1, 1), 16, 10).cast("int") < 12).select("system", "weights_sha").distinct()


@query(f"WITH {_SYSTEMS} SELECT system, dataset, round(pauc, 6) pauc FROM r SEMI JOIN m USING (system, weights_sha)")
def verified_rows(spark, sf):
    r, m = _systems(spark, sf)
    return rounded(runs.verified(r, m).select("system", "dataset", "pauc"), "pauc")


@query(f"WITH {_SYSTEMS}, b AS (SELECT system, dataset, min(weights_sha) weights_sha, min(pauc) pauc FROM r SEMI JOIN m USING (system, weights_sha) GROUP BY ALL) SELECT system, {', '.join(f'round(min(pauc) FILTER (dataset = {d!r}), 6) {d}' for d in ('d0', 'd1', 'd2', 'd3'))} FROM b GROUP BY system")
def ablations(spark, sf):
    """The best score of verified weights, a column a dataset."""
    r, m = _systems(spark, sf)
    best = runs.verified(r, m).groupBy("system", "dataset").agg(F.min("weights_sha").alias("weights_sha"), F.min("pauc").alias("pauc"))
    t = stats.ablation_table(best, best.select("system", "weights_sha"))
    for d in ("d0", "d1", "d2", "d3"):
        t = t if d in t.columns else t.withColumn(d, F.lit(None).cast("double"))
    return rounded(t.select("system", "d0", "d1", "d2", "d3"), "d0", "d1", "d2", "d3")


@query(f"""WITH {_LANGS}, s AS (SELECT *, row_number() OVER (ORDER BY lang) i, n % 3 > 0 has, n % 2 = 0 ok FROM langs), w AS (SELECT a.lang, a.ok, (SELECT arg_min(b.lang, b.i) FROM s b WHERE b.i < a.i AND NOT b.has) lost FROM s a)
SELECT lang AS stage, lost IS NULL AND ok may, CASE WHEN lost IS NOT NULL THEN lost || ' has no result' WHEN NOT ok THEN lang || ' is not approved' ELSE '' END why FROM w""")
def stages_that_may_run(spark, sf):
    """A stage a language, in order; what is approved and what has results goes by its number of documents."""
    n = {r.lang: r.n for r in langs(spark, sf).orderBy("lang").collect()}
    results = {k: {"accuracy": 0.5} for k, v in n.items() if v % 3}
    out = [(k, *runs.may_run(k, list(n), {x for x, v in n.items() if v % 2 == 0}, results, 0.1)) for k in n]
    return rows(spark, out, "stage string, may boolean, why string")


# Gates and decisions -------------------------------------------------------------------------------------------------


@query("SELECT source system, CASE WHEN count(*) % 2 = 1 AND count(*) % 3 > 0 THEN '' ELSE concat_ws('; ', CASE WHEN count(*) % 2 <> 1 THEN 'seed is 0, not 1' END, CASE WHEN count(*) % 3 = 0 THEN 'mode is missing, not full' END) END problems FROM documents GROUP BY source HAVING NOT (count(*) % 2 = 1 AND count(*) % 3 > 0)")
def config_mismatches(spark, sf):
    c = documents(spark, sf).groupBy(F.col("source").alias("system")).agg((F.count("*") % 2).alias("seed"), F.when(F.count("*") % 3 > 0, "full").alias("mode"))
    return stats.mismatches(c, {"seed": "1", "mode": "full"}).withColumn("problems", F.array_join("problems", "; "))


@query("SELECT doc_id, i, CASE WHEN i = doc_id % 2 THEN 0e0 ELSE round(1e0 / (1 + doc_id % 4), 6) END p FROM documents, (SELECT unnest(range(5)) i) WHERE i < 2 + doc_id % 4")
def failed_answers(spark, sf):
    n, r = (F.col("doc_id") % 4 + 2).cast("int"), (F.col("doc_id") % 2).cast("int")
    return rounded(documents(spark, sf).select("doc_id", F.posexplode(prob.failed_answer(n, r)).alias("i", "p")), "p")


_SIZED = f"s AS (SELECT 1 + doc_id % 5 size, avg(CASE WHEN {u('right', 'doc_id')} < 0.7e0 THEN 1e0 ELSE 0e0 END) accuracy, abs(avg({u('right', 'doc_id')}) - 0.5e0) ece, max({u('slow', 'doc_id')}) * 50 p95 FROM documents GROUP BY 1)"


@query(f"WITH {_SIZED} SELECT min(size)::BIGINT size FROM s WHERE accuracy >= (SELECT max(accuracy) FROM s) - 0.06e0 AND ece <= 0.05e0 AND p95 <= 50 HAVING count(*) > 0")
def chosen_size(spark, sf):
    s = documents(spark, sf).groupBy((F.col("doc_id") % 5 + 1).cast("int").alias("size")).agg(F.avg((draw("right") < 0.7).cast("double")).alias("accuracy"), F.abs(F.avg(draw("right")) - 0.5).alias("ece"), (F.max(draw("slow")) * 50).alias("p95"))
    return questions.model_size(s, 0.06, 0.05, 50.0).select("size")


_KINDS = f"f AS (SELECT source dataset, lang baseline, CASE WHEN n % 2 = 0 THEN 'leak' ELSE 'over' END kind, {u('d', 'source', 'lang')} - 0.9e0 diff, {u('p', 'source', 'lang')} ** 6 * 0.05e0 p, {u('fit', 'source', 'lang')} < 0.8e0 feasible, {u('e', 'source', 'lang')} * 0.055e0 ece FROM cells)"


@query(f"""WITH {_CELLS}, {_KINDS}, o AS (SELECT *, dataset || '|' || baseline || '|' || kind AS name FROM f WHERE feasible), h AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p, name) - 1 i, count(*) OVER (PARTITION BY kind) m FROM o),
r AS (SELECT *, min(CASE WHEN p <= 0.05e0 / (m - i) THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY p, name ROWS UNBOUNDED PRECEDING) = 1 reject FROM h), d AS (SELECT dataset, bool_and(diff < 0 AND reject AND ece <= 0.05e0) win FROM r GROUP BY dataset)
SELECT coalesce(string_agg(dataset, ',' ORDER BY dataset) FILTER (win), '') won, count(*) FILTER (win) >= 3 holds FROM d""")
def selective_wins(spark, sf):
    """A cell a source and language; each kind is a family of its own, infeasible cells are left out."""
    by = ("source", "lang")
    c = cells(spark, sf).select(F.col("source").alias("dataset"), F.col("lang").alias("baseline"), F.when(F.col("n") % 2 == 0, "leak").otherwise("over").alias("kind"), (draw("d", *by) - 0.9).alias("diff"), (F.pow(draw("p", *by), F.lit(6.0)) * 0.05).alias("p"), (draw("fit", *by) < 0.8).alias("feasible"), (draw("e", *by) * 0.055).alias("ece"))
    return stats.selective_decision(c).withColumn("won", F.array_join("won", ","))


@query(f"WITH r(name, least) AS (VALUES ('en', 0.5::DOUBLE), ('de', 0.45), ('fr', 0.48), ('xx', 1.0)), v AS (SELECT lang AS name, avg({u('gate', 'doc_id')}) v FROM documents GROUP BY lang) SELECT name, least, round(v, 6) AS \"value\", coalesce(v >= least, false) ok FROM r LEFT JOIN v USING (name)")
def checked_gates(spark, sf):
    """Means by language against least values; one that nothing has fails."""
    v = documents(spark, sf).groupBy(F.col("lang").alias("name")).agg(F.avg(draw("gate")).alias("value"))
    return rounded(stats.gates(v, {"en": 0.5, "de": 0.45, "fr": 0.48, "xx": 1.0}).select("name", "least", "value", "ok"), "value")


@query(f"""WITH s AS (SELECT doc_id % 7 seed, CASE WHEN doc_id % 7 < 6 THEN avg({u('rec', 'doc_id')}) END recall, abs(avg({u('cal', 'doc_id')}) - 0.5e0) ece FROM documents GROUP BY 1, doc_id % 7 < 6)
SELECT seed, concat_ws(',', CASE WHEN NOT coalesce(recall >= 0.5e0, false) THEN 'recall' END, CASE WHEN NOT coalesce(ece <= 0.02e0, false) THEN 'ece' END) failed, CASE WHEN recall IS NULL OR ece IS NULL THEN 'INVALID' WHEN recall >= 0.5e0 AND ece <= 0.02e0 THEN 'GO' ELSE 'NO-GO' END verdict FROM s""")
def go_no_go(spark, sf):
    """A seed a remainder of the id; the last has no recall."""
    s = documents(spark, sf).groupBy((F.col("doc_id") % 7).alias("seed")).agg(F.avg(draw("rec")).alias("recall"), F.abs(F.avg(draw("cal")) - 0.5).alias("ece")).withColumn("recall", F.when(F.col("seed") < 6, F.col("recall")))
    return stats.go_no_go(s, {"recall": "recall >= 0.5", "ece": "ece <= 0.02"}).withColumn("failed", F.array_join("failed", ","))


@query(f"""WITH g AS (SELECT lang, count(*) groups, count(*) FILTER ({u('off', 'doc_id')} < 0.4e0) off_, count(*) FILTER ({u('on', 'doc_id')} < 0.45e0) on_, avg({u('prec', 'doc_id')}) * 0.2e0 + 0.8e0 precision_, avg({u('x', 'doc_id')} - {u('y', 'doc_id')}) micro, avg({u('x', 'doc_id')} - {u('z', 'doc_id')}) macro FROM documents GROUP BY lang)
SELECT lang, precision_ >= 0.9e0 AND on_ > off_ propagation, micro > 0 AND macro > 0 both_better FROM g""")
def paired_gates(spark, sf):
    """Whether copying mentions pays, and whether both averages rise, by language."""
    g = documents(spark, sf).groupBy("lang").agg(F.count("*").alias("groups"), F.count_if(draw("off") < 0.4).alias("off"), F.count_if(draw("on") < 0.45).alias("on"), (F.avg(draw("prec")) * 0.2 + 0.8).alias("precision"), F.avg(draw("x") - draw("y")).alias("micro"), F.avg(draw("x") - draw("z")).alias("macro"))
    out = []
    for r in g.collect():  # languages
        off, on = ({"all_masked": k, "groups": r.groups} for k in (r.off, r.on))
        micro, macro = ({"diff": d, "p_value": 0.01} for d in (r.micro, r.macro))
        out.append((r.lang, stats.propagation_gate(off, on, r.precision), stats.both_win(micro, macro)))
    return rows(spark, out, "lang string, propagation boolean, both_better boolean")
