"""Registered queries of sweeps over variants, detectors by name, telephone numbers, and whole decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import prob
from spanloom.operators import detectors, numbering, questions, runs, stats, sweeps, vectors
from spanloom.plans import demo
from spanloom.plans.catalog import _FAMILY, _HOLM, _family, query, rounded, values
from spanloom.plans.coverage import draw
from spanloom.plans.demo import EVAL, documents, u
from spanloom.session import table

# Telephone numbers ---------------------------------------------------------------------------------------------------

_PLAN = values([(p, len(numbering.places(p)), a, b) for p, a, b in numbering.RULES], "lead", "depth", "least", "most")
_BETWEEN, _TIGHT = (p.replace("'", "''") for p in (numbering.BETWEEN, numbering.TIGHT))


@query(rf"""WITH RECURSIVE e AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+') m, string_split_regex(text, '[0-9]+') g FROM documents WHERE regexp_matches(text, '[0-9]')),
q AS (SELECT doc_id, text, m, g, [CASE WHEN i = 1 OR i > len(m) THEN '' ELSE g[i] END for i in range(1, len(m) + 2)] z FROM e),
f AS (SELECT *, [CASE WHEN m[i] = '0' AND z[i] LIKE '%(' AND z[i + 1] LIKE ')%' THEN '' ELSE m[i] END for i in range(1, len(m) + 1)] d FROM q),
o AS (SELECT doc_id, text, m, z, d, g, unnest(range(1, len(m) + 1)) i FROM f),
p AS (SELECT *, coalesce(sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i), 0)::BIGINT e FROM o),
c AS (SELECT *, e - length(m[i]) s, unnest(range(0, {numbering.GROUPS})) k FROM p),
ends AS (SELECT doc_id, i pos, e FROM p),
w AS (SELECT c.doc_id, c.text, c.i, c.i + k j, c.s, ends.e, array_to_string(c.d[c.i:c.i + k], '') n, contains(array_to_string(c.z[c.i + 1:c.i + k], ''), ')') closed FROM c JOIN ends ON ends.doc_id = c.doc_id AND ends.pos = c.i + k
 WHERE NOT regexp_matches(c.z[c.i], '{_TIGHT}') AND NOT regexp_matches(c.z[c.i + k + 1], '{_TIGHT}') AND len([x for x in c.z[c.i + 1:c.i + k] if NOT regexp_matches(x, '{_BETWEEN}')]) = 0),
x AS (SELECT *, substr(text, greatest(s - 1, 1)::INT, least(2, s)::INT) b FROM w WHERE length(n) BETWEEN {numbering.LEAST - 1} AND {numbering.MOST}),
y AS (SELECT *, b LIKE '%+' OR closed AND b = '+(' plus, CASE WHEN closed AND b = '+(' THEN 2 WHEN b LIKE '%+' OR closed AND b LIKE '%(' THEN 1 ELSE 0 END sign FROM x),
a AS (SELECT *, CASE WHEN plus THEN n WHEN n LIKE '011%' THEN substr(n, 4) WHEN n LIKE '1%' THEN n ELSE '1' || n END said FROM y
 WHERE NOT (s > sign AND regexp_matches(substr(text, (s - sign)::INT, 1), '[\p{{L}}\p{{N}}_$£€¥%+#]')) AND NOT regexp_matches(substr(text, (e + 1)::INT, 1), '[\p{{L}}_%]')),
r AS (SELECT said, arg_max(most, (depth, most = 0)) = 0 refused, max(depth) deep FROM (SELECT DISTINCT said FROM a), {_PLAN} WHERE regexp_matches(said, '^' || lead) GROUP BY said),
v AS (SELECT DISTINCT r.said FROM r, {_PLAN} t WHERE NOT refused AND depth = deep AND regexp_matches(r.said, '^' || lead) AND length(r.said) BETWEEN least AND most AND length(r.said) BETWEEN {numbering.LEAST} AND {numbering.MOST}),
best AS (SELECT doc_id, i, max(j) j, arg_max(s - sign, j) s, arg_max(e, j) e FROM a JOIN v USING (said) GROUP BY doc_id, i),
nxt AS (SELECT l.*, (SELECT min(b.i) FROM best b WHERE b.doc_id = l.doc_id AND b.i > l.j) n FROM best l),
walk AS (SELECT * FROM nxt WHERE (doc_id, i) IN (SELECT (doc_id, min(i)) FROM best GROUP BY doc_id) UNION ALL SELECT nxt.* FROM walk JOIN nxt ON nxt.doc_id = walk.doc_id AND nxt.i = walk.n)
SELECT w.doc_id, w.s AS "start", w.e AS "end", substr(d.text, (w.s + 1)::INT, (w.e - w.s)::INT) surface FROM walk w JOIN documents d USING (doc_id)""")
def phone_numbers(spark, sf):
    """Telephone numbers of the plan in whole texts."""
    return numbering.phones(documents(spark, sf).select("doc_id", "text"))


# Sweeps --------------------------------------------------------------------------------------------------------------

SIZES, DISTRACTORS = (3, 5, 8), 5


def _logit(salt: str, scale: float):
    return prob.unit(salt, F.col("doc_id"), F.col("start"), F.col("label")) * scale


def _l(salt: str, scale: str) -> str:
    return f"{u(salt, 'doc_id', chr(34) + 'start' + chr(34), 'label')} * {scale}"


@query(f"""WITH {EVAL}, l AS (SELECT doc_id, "start", "end", [score * 4e0, {_l('l1', '2e0')}, {_l('l2', '2e0')}, {', '.join(_l(f'x{i}', '2e0') for i in range(DISTRACTORS))}] q, {_l('none', '3e0')} o FROM preds),
t AS (SELECT *, (exp(q[1]) + exp(q[2])) / (exp(q[1]) + exp(q[2]) + exp(q[3]) + exp(o)) base FROM l), n AS (SELECT unnest([{', '.join(map(str, SIZES))}])::BIGINT n),
v AS (SELECT n, doc_id, "start", "end", (exp(q[1]) + exp(q[2])) / (list_sum([exp(x) for x in q[1:n]]) + exp(o)) s, base, o > list_max(q[1:n]) nw FROM t, n),
m AS (SELECT n, avg(abs(s - base)) drift, avg(nw::INT) none_share FROM v GROUP BY n),
vb AS (SELECT v.n, r.doc_id, r.idx, max(1 + floor(least(round(s, 6), 1e0) * 1000 + 1e-9))::BIGINT vbin FROM runs r JOIN v ON r.doc_id = v.doc_id AND r."start" < v."end" AND r."end" > v."start" GROUP BY ALL),
vh AS (SELECT n, coalesce(vbin, 0) b, sum(n_pii)::BIGINT p, sum(n_non)::BIGINT q FROM scored CROSS JOIN n LEFT JOIN vb USING (n, doc_id, idx) GROUP BY ALL),
g AS (SELECT n, unnest(range(1, 1003)) b FROM n), ut AS (SELECT g.n, g.b, sum(coalesce(p, 0)) OVER w up, sum(coalesce(q, 0)) OVER w un FROM g LEFT JOIN vh ON vh.n = g.n AND vh.b = g.b WINDOW w AS (PARTITION BY g.n ORDER BY g.b DESC)),
al AS (SELECT n, sum(p) ap, sum(q) aq FROM vh GROUP BY n), cv AS (SELECT n, CASE WHEN b = 1002 THEN 1e0 ELSE 1 - up / ap END leak, CASE WHEN b = 1002 THEN 0e0 ELSE un / aq END over_ FROM ut JOIN al USING (n)),
o2 AS (SELECT n, over_, min(leak) OVER (PARTITION BY n ORDER BY over_, leak ROWS UNBOUNDED PRECEDING) low, lead(over_) OVER (PARTITION BY n ORDER BY over_, leak) nxt FROM cv),
ar AS (SELECT n, sum(low * (least(coalesce(nxt, 'inf'::DOUBLE), 0.05e0) - least(over_, 0.05e0))) / 0.05e0 pauc FROM o2 GROUP BY n)
SELECT n::VARCHAR variant, round(pauc, 6) pauc, round(drift, 6) mean_abs_drift, round(none_share, 6) none_share FROM ar JOIN m USING (n)""")
def label_set_sweep(spark, sf):
    """Partial area, drift of P(sensitive) and share of none as a label set grows by labels that aren't sensitive."""
    _, g, p = demo.world(spark, sf)
    logits = F.array(F.col("score") * 4, _logit("l1", 2.0), _logit("l2", 2.0), *[_logit(f"x{i}", 2.0) for i in range(DISTRACTORS)])
    p = p.select("doc_id", "start", "end", logits.alias("logits"), _logit("none", 3.0).alias("none"))
    p = sweeps.padded(p, "logits", "none", (True, True, False), SIZES).withColumn("score", F.round("score", 6))
    h = sweeps.text_histograms(documents(spark, sf), p, g, [str(n) for n in SIZES])
    return rounded(sweeps.report(h, p), "pauc", "mean_abs_drift", "none_share")


# Detectors by name ---------------------------------------------------------------------------------------------------

_MAILS = r"""e AS (SELECT doc_id, regexp_extract_all(text, p) m, string_split_regex(text, p) g FROM documents, (SELECT '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+' p) WHERE regexp_matches(text, p)),
o AS (SELECT doc_id, unnest(m) surface, unnest([list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) for i in range(1, len(m) + 1)])::BIGINT s FROM e)"""


@query(rf"""WITH {_MAILS} SELECT doc_id, s AS "start", s + length(surface) AS "end", 'EMAIL' label, 1e0 score FROM o""")
def registered_detector(spark, sf):
    """A detector called by name as a lateral table function over windows of whole texts; SQL finds the same in whole texts."""
    return detectors.accepted(detectors.detections(documents(spark, sf), "patterns"))


@query(r"""SELECT 'unknown_label' status, 'year' raw, count(DISTINCT doc_id) docs FROM documents WHERE regexp_matches(text, '(^|[^0-9])[0-9]{4}([^0-9]|$)')
UNION ALL SELECT 'ok', 'email', count(*) FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]')""")
def detector_outcomes(spark, sf):
    """Documents with detections that were admitted, and with those of a label that isn't."""
    f = detectors.detections(documents(spark, sf), "patterns")
    return f.groupBy("status", "raw").agg(F.countDistinct("doc_id").alias("docs"))


# Labels in vector space ----------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) x FROM embeddings, (SELECT unnest(range(1, 65)) i) GROUP BY ALL), l AS (SELECT label, list(x ORDER BY i) v FROM m GROUP BY label), n AS (SELECT label, label % 3 <> 0 seen, [x / sqrt(list_sum([y * y for y in v])) for x in v] v FROM l),
s AS (SELECT a.label, a.seen, max(list_sum([a.v[i] * b.v[i] for i in range(1, 65)])) c FROM n a JOIN n b ON b.seen AND a.label <> b.label GROUP BY ALL), g AS (SELECT avg(c) FILTER (NOT seen) h, avg(c) FILTER (seen) o FROM s)
SELECT round(h, 6) heldout_nearest_seen, round(o, 6) seen_nearest_other_seen, round(h - o, 6) gap FROM g""")
def projection_gap(spark, sf):
    """Mean vectors of labels, every third held out."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    m = vectors.with_unit(m).select(F.col("label").cast("bigint").alias("id"), (F.col("label") % 3 != 0).alias("seen"), "unit")
    return rounded(vectors.projection_gap(m), "heldout_nearest_seen", "seen_nearest_other_seen", "gap")


# Questions -----------------------------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT doc_id, [{u('p0', 'doc_id')} + 0.01e0, {u('p1', 'doc_id')} + 0.01e0] q, {u('path', 'doc_id')} * 0.02e0 d FROM documents), p AS (SELECT q[1] / list_sum(q) x, d FROM a)
SELECT count(*) n, round(max(abs(d)), 6) max_abs_diff, round(avg(CASE WHEN (x >= 1 - x) = (x - d >= 1 - x + d) THEN 1e0 ELSE 0e0 END), 6) argmax_agree FROM p""")
def compared_paths(spark, sf):
    """Probabilities of the same questions by two ways: how far apart they are, and whether they choose alike."""
    d = documents(spark, sf).select((draw("p0") + 0.01).alias("x"), (draw("p1") + 0.01).alias("y"), (draw("path") * 0.02).alias("d")).withColumn("x", F.col("x") / (F.col("x") + F.col("y")))
    d = d.select(F.array(F.col("x"), 1 - F.col("x")).alias("a"), F.array(F.col("x") - F.col("d"), 1 - F.col("x") + F.col("d")).alias("b"))
    return rounded(questions.path_comparison(d), "max_abs_diff", "argmax_agree")


@query(f"SELECT replace(source, '_', ' ') || ' text' AS name, description, count(*) n FROM (SELECT source, lang description FROM documents) GROUP BY ALL UNION ALL SELECT '{questions.NONE}', 'nothing', count(*) FROM documents")
def restyled_options(spark, sf):
    """Options named after sources, with spaces, and another description of none."""
    o = F.array(F.struct(F.concat("source", F.lit("_text")).alias("name"), F.col("lang").alias("description")), F.struct(F.lit(questions.NONE).alias("name"), F.lit("-").alias("description")))
    d = documents(spark, sf).select(F.inline(questions.restyled(o, True, "nothing")))
    return d.groupBy("name", "description").agg(F.count("*").alias("n"))


@query("SELECT reason, count(*) n FROM (SELECT CASE doc_id % 5 WHEN 1 THEN 'timeout' WHEN 2 THEN 'invalid_answer' WHEN 3 THEN 'invalid_answer' WHEN 4 THEN 'length' END reason FROM documents) WHERE reason IS NOT NULL GROUP BY ALL")
def error_reasons(spark, sf):
    """Answers that can't be used: none with an error, other keys, a negative value, an error beside an answer too short."""
    k = F.col("doc_id") % 5
    both = lambda x, y, other="b": F.create_map(F.lit("a"), F.lit(x), F.lit(other), F.lit(y))
    answer = F.when(k == 0, both(0.25, 0.75)).when(k == 2, both(0.5, 0.5, "c")).when(k == 3, both(-0.5, 1.5)).when(k == 4, F.create_map(F.lit("a"), F.lit(1.0)))
    error = F.when(k == 1, "timeout").when(k == 4, "length")
    return questions.answer_errors(documents(spark, sf).select(F.array(F.lit("a"), F.lit("b")).alias("options"), answer.alias("answer"), error.alias("error")))


# Runs and decisions --------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT source || '-' || lang run, count(*) n FROM documents GROUP BY ALL), s AS (SELECT run, n, CASE n % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'reuse' WHEN 2 THEN 'resume' ELSE 'archive' END state FROM d)
SELECT run, state, CASE WHEN state = 'archive' AND n % 5 = 3 THEN run || '.stale-' || substr(sha256(run), 1, 12) || CASE WHEN n % 2 = 0 THEN '-1' ELSE '' END WHEN state = 'archive' THEN run || '.stale-nohash' END archive FROM s
UNION ALL SELECT run || '.stale-' || substr(sha256(run), 1, 12), 'new', NULL FROM s WHERE n % 2 = 0""")
def run_states(spark, sf):
    """A run for each source and language: reused, resumed or moved aside, by its manifest; half of the first names are taken."""
    d = documents(spark, sf).groupBy(F.concat_ws("-", "source", "lang").alias("run")).agg(F.count("*").alias("n"))
    k, tag = F.col("n") % 5, F.sha2("run", 256)
    hashes = F.when(k.isin(1, 2), F.create_map(F.lit("questions"), F.col("run"), F.lit("other"), F.lit("x"))).when(k == 3, F.create_map(F.lit("questions"), tag))
    have = d.select("run", hashes.alias("hashes"), (k == 1).alias("done"), (k != 0).alias("present"))
    taken = d.where("n % 2 = 0").select(F.concat("run", F.lit(".stale-"), F.substring(tag, 1, 12)).alias("run"), F.lit(None).cast("map<string,string>").alias("hashes"), F.lit(False).alias("done"), F.lit(False).alias("present"))
    return runs.run_states(have.unionByName(taken), d.select("run", F.lit("questions").alias("name"), F.col("run").alias("value")))


_GRID = "docs AS (SELECT source dataset, count(*) n FROM documents GROUP BY ALL), grid AS (SELECT DISTINCT source dataset, lang baseline FROM documents)"
_INDEX = f"""ix AS (SELECT dataset, 'ours' AS system, s seed, 'head' revision, n - CASE WHEN {u('short', 'dataset', 's')} < 0.1e0 THEN 1 ELSE 0 END k, CASE WHEN {u('set', 'dataset', 's')} < 0.2e0 THEN 'off' ELSE 'on' END validators FROM docs, (SELECT unnest([0, 1, 2]) s) WHERE {u('there', 'dataset', 's')} < 0.9e0
UNION ALL SELECT dataset, baseline, NULL, CASE WHEN {u('rev', 'dataset', 'baseline')} < 0.2e0 THEN 'r0' ELSE 'r1' END, n - CASE WHEN {u('short', 'dataset', 'baseline')} < 0.1e0 THEN 1 ELSE 0 END, 'on' FROM grid JOIN docs USING (dataset) WHERE {u('there', 'dataset', 'baseline')} < 0.9e0)"""
_PROBLEMS = """pr AS (SELECT dataset, 'ours ' || s AS system, 'missing' problem FROM docs, (SELECT unnest([0, 1, 2]) s) WHERE (dataset, s) NOT IN (SELECT (dataset, seed) FROM ix WHERE system = 'ours')
UNION ALL SELECT dataset, baseline, 'missing' FROM grid WHERE (dataset, baseline) NOT IN (SELECT (dataset, system) FROM ix)
UNION ALL SELECT dataset, concat_ws(' ', system, seed), 'incomplete' FROM ix JOIN docs USING (dataset) WHERE k <> n
UNION ALL SELECT dataset, baseline, 'unpinned' FROM grid WHERE baseline = 'fr' UNION ALL SELECT dataset, system, 'revision' FROM ix WHERE system NOT IN ('ours', 'fr') AND revision <> 'r1'
UNION ALL SELECT dataset, concat_ws(' ', system, seed), 'setting' FROM ix WHERE system = 'ours' AND validators <> 'on')"""


def _problems(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(grid, problems): a data set a source, a baseline a language; files that are there by draw, one baseline not pinned."""
    d = documents(spark, sf)
    docs = d.groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("n_docs"))
    grid = d.select(F.col("source").alias("dataset"), F.col("lang").alias("baseline")).distinct()
    short = lambda *k: F.col("n_docs") - F.when(draw("short", *k) < 0.1, 1).otherwise(0)
    ours = docs.withColumn("seed", F.explode(F.lit([0, 1, 2]))).where(draw("there", "dataset", "seed") < 0.9)
    ours = ours.select("dataset", F.lit("ours").alias("system"), "seed", F.lit("head").alias("revision"), short("dataset", "seed").alias("n_docs"), F.when(draw("set", "dataset", "seed") < 0.2, "off").otherwise("on").alias("validators"))
    base = grid.join(docs, "dataset").where(draw("there", "dataset", "baseline") < 0.9)
    base = base.select("dataset", F.col("baseline").alias("system"), F.lit(None).cast("int").alias("seed"), F.when(draw("rev", "dataset", "baseline") < 0.2, "r0").otherwise("r1").alias("revision"), short("dataset", "baseline").alias("n_docs"), F.lit("on").alias("validators"))
    pins = grid.select(F.col("baseline").alias("system")).distinct().select("system", F.when(F.col("system") != "fr", "r1").alias("revision"))
    return grid, stats.family_problems(grid, ours.unionByName(base), pins, docs, "ours", (0, 1, 2), {"validators": "on"})


@query(f"WITH {_GRID}, {_INDEX}, {_PROBLEMS} SELECT dataset, system, problem FROM pr")
def family_problems(spark, sf):
    return _problems(spark, sf)[1]


@query(f"""WITH {_GRID}, {_INDEX}, {_PROBLEMS}, {_FAMILY}, {_HOLM}, w AS (SELECT dataset, bool_and(diff < 0 AND reject) win, count(*) k FROM r GROUP BY dataset)
SELECT name, sum(k)::BIGINT family, coalesce(string_agg(dataset, ',' ORDER BY dataset) FILTER (win), '') won, n_problems, 0::BIGINT lacking, CASE WHEN n_problems > 0 THEN 'open' WHEN count(*) FILTER (win) >= 2 THEN 'holds' ELSE 'fails' END verdict
FROM w, (SELECT 'as found' AS name, count(*) n_problems FROM pr UNION ALL SELECT 'once mended', 0) GROUP BY name, n_problems""")
def whole_decision(spark, sf):
    """The family's decision: open while files are missing, short, unpinned or set otherwise, and what it is once they aren't."""
    grid, problems = _problems(spark, sf)
    out = [stats.family_decision(_family(spark, sf), grid, p, needed=2).withColumn("name", F.lit(name)) for name, p in (("as found", problems), ("once mended", problems.limit(0)))]
    verdict = F.when(F.col("holds").isNull(), "open").when(F.col("holds"), "holds").otherwise("fails")
    return out[0].unionByName(out[1]).withColumn("won", F.array_join("won", ",")).select("name", "family", "won", "n_problems", "lacking", verdict.alias("verdict"))
