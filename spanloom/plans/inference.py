"""Registered queries of resampling, of ranks over all rows, and of fits by group, with SQL that works out the same numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import prob
from spanloom.operators import bootstrap, calibration, spans
from spanloom.plans import demo
from spanloom.plans.catalog import _SD, hist, query, rounded
from spanloom.plans.demo import EVAL, GOLD, documents, preds_sql, u
from spanloom.schema import PII_TYPES
from spanloom.session import table

DRAWS, SEED = 400, 11
#: Levels of the tree in SQL: enough for 16,384 documents; the operator goes as deep as it takes.
LEVELS = 14


def _level(at: int) -> str:
    """CTEs that split the counts of a level between the halves of its nodes."""
    m = "18446744073709551616::UHUGEINT"
    fixed = (SEED * bootstrap.KEYS["seed"] + at * bootstrap.KEYS["level"]) % 2**64
    (s1, f1), (s2, f2) = bootstrap.MIX
    mass = "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))"
    return f"""z{at} AS (SELECT draw, k, n, (k * c) >> {at} lo, ((2 * k + 1) * c) >> {at + 1} mid, ((k + 1) * c) >> {at} hi, (({fixed}::UHUGEINT + draw::UHUGEINT * {bootstrap.KEYS['draw']}::UHUGEINT % {m} + k::UHUGEINT * {bootstrap.KEYS['node']}::UHUGEINT % {m}) % {m})::UBIGINT z FROM w{at}, size),
y{at} AS (SELECT *, (xor(z, z >> {s1})::UHUGEINT * {f1}::UHUGEINT % {m})::UBIGINT y FROM z{at}), x{at} AS (SELECT *, (xor(y, y >> {s2})::UHUGEINT * {f2}::UHUGEINT % {m})::UBIGINT x FROM y{at}),
u{at} AS (SELECT draw, k, n, lo, mid, hi, (mid - lo) / greatest(hi - lo, 1) p, (xor(x, x >> 31) >> 11) / 9007199254740992e0 u FROM x{at}),
f{at} AS (SELECT draw, k, u, sum({mass}) OVER (PARTITION BY draw, k ORDER BY j ROWS UNBOUNDED PRECEDING) f FROM (SELECT *, unnest(range(n + 1)) j FROM u{at} WHERE mid > lo AND mid < hi)),
g{at} AS (SELECT draw, k, count(*) FILTER (f < u) l FROM f{at} GROUP BY ALL),
s{at} AS (SELECT u{at}.*, CASE WHEN mid = lo THEN 0 WHEN mid = hi THEN n ELSE l END l FROM u{at} LEFT JOIN g{at} USING (draw, k)),
w{at + 1} AS (SELECT draw, 2 * k k, l n FROM s{at} WHERE l > 0 UNION ALL SELECT draw, 2 * k + 1, n - l FROM s{at} WHERE n > l)"""


#: w (draw, cluster, weight): the weights of every draw over all documents; draw -1 is the sample itself.
WEIGHTS = f"""ids AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 idx FROM (SELECT DISTINCT doc_id AS cluster FROM documents)), size AS (SELECT count(*) c FROM ids),
w0 AS (SELECT unnest(range({DRAWS})) draw, 0::BIGINT k, c n FROM size),
{''.join(_level(i) + ', ' for i in range(LEVELS))}
w AS (SELECT draw, cluster, n weight FROM w{LEVELS}, size JOIN ids ON idx = (k * c) >> {LEVELS} UNION ALL SELECT -1, cluster, 1 FROM ids)"""
_AFTER = {"lower_95": 0.025, "upper_95": 0.975, "one_sided_lower_95": 0.05, "one_sided_upper_95": 0.95}
_INTERVAL = ", ".join(f"round(quantile_cont({{0}}, {q}) FILTER (draw >= 0), 6) {n}" for n, q in _AFTER.items())
_P = f"round(least(1e0, 2 * least((count(*) FILTER (draw >= 0 AND d <= 0) + 1) / {DRAWS + 1}, (count(*) FILTER (draw >= 0 AND d >= 0) + 1) / {DRAWS + 1})), 6) p_value"
_BOUNDS = tuple(_AFTER)


def everyone(spark, sf):
    return documents(spark, sf).select(F.col("doc_id").alias("cluster"))


_SCORED_B = """bins_b AS (SELECT r.doc_id, r.idx, max(1 + floor(least(p.score, 1e0) * 1000 + 1e-9))::BIGINT bin FROM runs r JOIN preds_b p ON r.doc_id = p.doc_id AND r."start" < p."end" AND r."end" > p."start" GROUP BY ALL),
scored_b AS (SELECT s.doc_id, coalesce(b.bin, 0) bin, n_pii, n_non FROM scored s LEFT JOIN bins_b b USING (doc_id, idx))"""


@query(f"""WITH {EVAL}, {preds_sql('b', 'preds_b')}, {_SCORED_B}, {WEIGHTS},
h AS (SELECT 'a' system, doc_id AS cluster, bin, sum(n_pii) p, sum(n_non) n FROM scored GROUP BY ALL UNION ALL SELECT 'b', doc_id, bin, sum(n_pii), sum(n_non) FROM scored_b GROUP BY ALL),
m AS (SELECT system, draw, bin, sum(weight * p)::BIGINT p, sum(weight * n)::BIGINT n FROM h JOIN w USING (cluster) GROUP BY ALL), t AS (SELECT system, draw, sum(p) tp, sum(n) tn FROM m GROUP BY ALL),
pts AS (SELECT system, draw, 1 - sum(p) OVER v / tp leak, sum(n) OVER v / tn over_ FROM m JOIN t USING (system, draw) WHERE bin > 0 WINDOW v AS (PARTITION BY system, draw ORDER BY bin DESC) UNION ALL SELECT system, draw, 1e0, 0e0 FROM t),
o AS (SELECT *, min(leak) OVER (PARTITION BY system, draw ORDER BY over_, leak ROWS UNBOUNDED PRECEDING) low, lead(over_) OVER (PARTITION BY system, draw ORDER BY over_, leak) nxt FROM pts),
v AS (SELECT system, draw, sum(low * (least(coalesce(nxt, 'inf'::DOUBLE), 0.05e0) - least(over_, 0.05e0))) / 0.05e0 v FROM o GROUP BY ALL),
d AS (SELECT a.draw, a.v a, b.v b, a.v - b.v d FROM v a JOIN v b USING (draw) WHERE a.system = 'a' AND b.system = 'b')
SELECT round(max(a) FILTER (draw = -1), 6) a, round(max(b) FILTER (draw = -1), 6) b, round(max(d) FILTER (draw = -1), 6) diff, round(quantile_cont(d, 0.025) FILTER (draw >= 0), 6) ci_low, round(quantile_cont(d, 0.975) FILTER (draw >= 0), 6) ci_high, {_P}, {DRAWS} n_boot, (SELECT c FROM size) n_clusters FROM d""")
def paired_bootstrap(spark, sf):
    """pAUC of two systems, documents as clusters."""
    f = None
    for s in ("a", "b"):
        x = bootstrap.histogram_features(hist(spark, sf, s), s)
        f = x if f is None else f.unionByName(x)
    d = bootstrap.drawn(f, 2 * prob.BINS, bootstrap.pauc, ("pauc",), DRAWS, SEED, everyone(spark, sf))
    r = bootstrap.differences(d, "b").select(F.col("value").alias("a"), F.col("baseline").alias("b"), F.col("difference").alias("diff"), F.col("lower_95").alias("ci_low"), F.col("upper_95").alias("ci_high"), "p_value")
    n = everyone(spark, sf).distinct().agg(F.count("*").alias("n_clusters"))
    return rounded(r, *r.columns).withColumn("n_boot", F.lit(DRAWS)).crossJoin(F.broadcast(n))


_F1_SYSTEMS = ("a", "b", "c")
_F1_COUNTS = ", ".join(f"""g{s} AS (SELECT '{s}' system, coalesce(p.doc_id, g.doc_id) AS cluster, coalesce(p.label, g.label) label, p.doc_id IS NOT NULL x, g.doc_id IS NOT NULL y
FROM (SELECT DISTINCT doc_id, "start", "end", label FROM preds_{s} WHERE score >= 0.3e0) p FULL JOIN (SELECT DISTINCT doc_id, "start", "end", label FROM gold) g ON p.doc_id = g.doc_id AND p."start" = g."start" AND p."end" = g."end" AND p.label = g.label)""" for s in _F1_SYSTEMS)


@query(f"""WITH {GOLD}, {', '.join(preds_sql(s, f'preds_{s}') for s in _F1_SYSTEMS)}, {_F1_COUNTS}, {WEIGHTS},
c AS (SELECT system, cluster, label, count(*) FILTER (x AND y) tp, count(*) FILTER (x AND NOT y) fp, count(*) FILTER (y AND NOT x) fn FROM ({' UNION ALL '.join(f'SELECT * FROM g{s}' for s in _F1_SYSTEMS)}) WHERE label IN ({demo.PII_LIST}) GROUP BY ALL),
m AS (SELECT system, draw, label, sum(weight * tp) tp, sum(weight * fp) fp, sum(weight * fn) fn FROM c JOIN w USING (cluster) GROUP BY ALL),
v AS (SELECT system, draw, 'micro' name, 2 * sum(tp) / greatest(1, sum(2 * tp + fp + fn)) v FROM m GROUP BY ALL UNION ALL SELECT system, draw, 'macro', avg(2 * tp / greatest(1, 2 * tp + fp + fn)) FROM m WHERE tp + fn > 0 GROUP BY ALL),
d AS (SELECT s.system, name, draw, s.v, b.v b, s.v - b.v d FROM v s JOIN v b USING (name, draw) WHERE s.system <> 'a' AND b.system = 'a')
SELECT system, name, round(max(v) FILTER (draw = -1), 6) AS "value", round(max(b) FILTER (draw = -1), 6) baseline, round(max(d) FILTER (draw = -1), 6) difference, {_INTERVAL.format('d')}, {_P} FROM d GROUP BY ALL""")
def f1_bootstrap(spark, sf):
    """Micro and macro F1 of systems b and c against a, from exact spans at a threshold, with one- and two-sided bounds."""
    f = None
    for s in _F1_SYSTEMS:
        _, g, p = demo.world(spark, sf, s)
        c = spans.typed_counts(p.where("score >= 0.3"), g, "doc_id").withColumnRenamed("doc_id", "cluster")
        x = bootstrap.f1_features(c, list(PII_TYPES), s)
        f = x if f is None else f.unionByName(x)
    d = bootstrap.drawn(f, 3 * len(PII_TYPES), bootstrap.f1, ("micro", "macro"), DRAWS, SEED, everyone(spark, sf))
    return rounded(bootstrap.differences(d, "a"), "value", "baseline", "difference", *_BOUNDS, "p_value")


@query(f"""WITH {GOLD}, {preds_sql('a')}, {WEIGHTS}, x AS (SELECT doc_id AS cluster, sum(score) s, count(*) k FROM preds GROUP BY ALL), v AS (SELECT draw, sum(weight * s) / sum(weight * k) v FROM x JOIN w USING (cluster) GROUP BY draw)
SELECT 'a' system, 'mean' name, round(max(v) FILTER (draw = -1), 6) AS "value", {_INTERVAL.format('v')} FROM v""")
def document_bootstrap(spark, sf):
    """Mean score of all predictions, documents resampled whole."""
    p = demo.preds(spark, sf).select(F.col("doc_id").alias("cluster"), F.col("score").alias("value"))
    d = bootstrap.drawn(bootstrap.mean_features(p, "a"), 2, bootstrap.mean, ("mean",), DRAWS, SEED, everyone(spark, sf))
    return rounded(bootstrap.intervals(d), "value", *_BOUNDS)


@query(f"""WITH {_SD}, {WEIGHTS}, x AS (SELECT doc_id AS cluster, least(floor(score * 15), 14) b, score, target FROM sd),
m AS (SELECT draw, b, sum(weight) k, sum(weight * score) p, sum(weight * target) y FROM x JOIN w USING (cluster) GROUP BY ALL),
v AS (SELECT draw, 'ece' name, sum(abs(p - y)) / sum(k) v FROM m GROUP BY draw UNION ALL SELECT draw, 'brier', sum(weight * (score - target) ** 2) / sum(weight) FROM x JOIN w USING (cluster) GROUP BY draw)
SELECT 'a' system, name, round(max(v) FILTER (draw = -1), 6) AS "value", {_INTERVAL.format('v')} FROM v GROUP BY name""")
def calibration_intervals(spark, sf):
    """Calibration error and Brier score with intervals over resampled clusters."""
    rows = demo.scored_docs(spark, sf).withColumnRenamed("doc_id", "cluster")
    d = bootstrap.drawn(bootstrap.calibration_features(rows, "a"), bootstrap.CALIBRATION, bootstrap.calibration, ("ece", "brier"), DRAWS, SEED, everyone(spark, sf))
    return rounded(bootstrap.intervals(d), "value", *_BOUNDS)


# Ranks of scores that are all different ------------------------------------------------------------------------------

_RAW = f"sd AS (SELECT l.doc_id, {u('doc', 'l.doc_id')} * 0.6e0 + quality * 0.4e0 score, quality target FROM labels l JOIN documents d USING (doc_id))"


def _raw(spark, sf):
    d = table(spark, sf, "labels").join(documents(spark, sf).select("doc_id"), "doc_id")
    return d.select("doc_id", (prob.unit("doc", F.col("doc_id")) * 0.6 + F.col("quality") * 0.4).alias("score"), F.col("quality").alias("target"))


@query(f"""WITH {_RAW}, n AS (SELECT count(*) n FROM sd), b AS (SELECT score, target, ntile(15) OVER (ORDER BY score, doc_id) b FROM sd), g AS (SELECT count(*) w, avg(score) p, avg(target) y FROM b GROUP BY b),
e AS (SELECT sum(w / n * abs(p - y)) ece FROM g, n), s AS (SELECT score, sum(target) p, sum(1 - target) q FROM sd GROUP BY score),
l AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) lower_ FROM s), a AS (SELECT sum(p * (lower_ + q / 2)) / (sum(p) * sum(q)) auroc FROM l)
SELECT round(ece, 6) ece, round(auroc, 6) auroc, round((SELECT list_sort(list(score))[(floor((count(*) - 1) * 0.1e0) + 1)::INT] FROM sd), 6) threshold FROM e, a""")
def ungridded_calibration(spark, sf):
    """Calibration error, AUROC and the threshold of nine tenths coverage, where every row has a score of its own."""
    d = _raw(spark, sf)
    both = calibration.adaptive_ece(d, "doc_id").crossJoin(F.broadcast(calibration.auroc(d)))
    return rounded(both.withColumn("threshold", F.lit(calibration.lower_quantile(d, 0.9))), "ece", "auroc", "threshold")


@query(f"WITH {_RAW}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) i, count(*) OVER () n, sum(1 - target) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) e FROM sd) SELECT i, round(i / n, 6) coverage, round(e / i, 6) risk FROM r")
def ungridded_risk_coverage(spark, sf):
    return rounded(calibration.risk_coverage(_raw(spark, sf), "doc_id"), "coverage", "risk")


# Fits by group -------------------------------------------------------------------------------------------------------

_HALF = u("half", "doc_id")


@query(f"""WITH {_SD}, f AS (SELECT label, score, target FROM sd WHERE {_HALF} < 0.5e0), few AS (SELECT label FROM f GROUP BY label HAVING count(*) >= 30), f2 AS (SELECT label, score, target FROM f JOIN few USING (label) UNION ALL SELECT 'all of them', score, target FROM f),
p AS (SELECT label, score x, count(*) k, sum(target) s FROM f2 GROUP BY ALL), c AS (SELECT label, x, row_number() OVER o i, sum(k) OVER o k, sum(s) OVER o s, k k1, s s1 FROM p WINDOW o AS (PARTITION BY label ORDER BY x)),
ab AS (SELECT a.label, a.i a, b.i b, (b.s - a.s + a.s1) / (b.k - a.k + a.k1) mean FROM c a JOIN c b ON a.label = b.label AND a.i <= b.i), mn AS (SELECT label, a, b i, min(mean) OVER (PARTITION BY label, a ORDER BY b DESC) m FROM ab),
fit AS (SELECT label, i, max(m) y FROM mn GROUP BY ALL), xy AS (SELECT label, x, y, coalesce(lead(x) OVER o, x) x1, coalesce(lead(y) OVER o, y) y1, row_number() OVER o i, count(*) OVER (PARTITION BY label) n FROM c JOIN fit USING (label, i) WINDOW o AS (PARTITION BY label ORDER BY x)),
r AS (SELECT doc_id, label, score, CASE WHEN label IN (FROM few) THEN label ELSE 'all of them' END fl FROM sd WHERE {_HALF} >= 0.5e0)
SELECT doc_id, r.label, score, round(CASE WHEN x1 = x OR score <= x THEN y ELSE y + (score - x) / (x1 - x) * (y1 - y) END, 6) fitted FROM r JOIN xy ON fl = xy.label AND (score >= x OR i = 1) AND (score < x1 OR i = n)""")
def isotonic_fit(spark, sf):
    """Scores of one half recalibrated by fits on the other: of their language if it has 30 rows, else of all."""
    d, half = demo.scored_docs(spark, sf), prob.unit("half", F.col("doc_id")) < 0.5
    blocks = calibration.isotonic_blocks(d.where(half), least=30)
    return rounded(calibration.isotonic(d.where(~half), blocks).drop("target"), "fitted")


KINDS = ("binary", "choice", "span", "unasked")
_Z = [f"6 * {u(f'z{i}', 'doc_id')}" for i in range(4)]
_STAGES = [("ln(0.05e0)", "ln(20e0)", 121)] + [(f"lt - {s:.8f}::DOUBLE", f"lt + {s:.8f}::DOUBLE", 41) for s in (0.05, 0.0025, 0.000125, 0.00000625)]


def _stage(i: int) -> str:
    lo, hi, n = _STAGES[i]
    grid = f"SELECT kind, greatest(ln(0.05e0), least(ln(20e0), {lo} + ({hi} - ({lo})) * i / {n - 1}e0)) lt FROM {'(SELECT DISTINCT kind FROM q)' if i == 0 else f't{i - 1}'}, (SELECT unnest(range({n})) i)"
    loss = "ln(list_sum([exp((x - list_max(z)) / exp(lt)) for x in z])) + (list_max(z) - z[y + 1]) / exp(lt)"
    return f"g{i} AS ({grid}), t{i} AS (SELECT kind, arg_min(lt, l) lt FROM (SELECT kind, lt, avg({loss}) l FROM g{i} JOIN q USING (kind) GROUP BY ALL) GROUP BY kind)"


@query(f"""WITH z AS (SELECT doc_id, ['binary', 'choice', 'span'][floor({u('kind', 'doc_id')} * 2.99e0)::INT + 1] kind, [{', '.join(_Z)}] z FROM documents),
q AS (SELECT kind, z, CASE WHEN {u('ok', 'doc_id')} < 0.55e0 THEN list_position(z, list_max(z)) - 1 ELSE least(3, floor({u('other', 'doc_id')} * 4)) END::INT y FROM z), {', '.join(_stage(i) for i in range(len(_STAGES)))}
SELECT kind, round(lt, 3) log_t FROM t{len(_STAGES) - 1} UNION ALL SELECT 'unasked', 0e0""")
def kind_temperatures(spark, sf):
    """Temperatures of three kinds of questions, and of one that nobody asked."""
    draw = lambda s: prob.unit(s, F.col("doc_id"))
    z = F.array(*[6 * draw(f"z{i}") for i in range(4)])
    d = documents(spark, sf).select("doc_id", demo.named(F.floor(draw("kind") * 2.99), KINDS[:3]).alias("kind"), z.alias("logits"))
    target = F.when(draw("ok") < 0.55, prob.argmax(F.col("logits"))).otherwise(F.least(F.lit(3), F.floor(draw("other") * 4)).cast("int"))
    t = calibration.fit_temperatures(d.withColumn("target", target), KINDS)
    return spark.createDataFrame(list(t.items()), "kind string, t double").select("kind", F.round(F.log("t"), 3).alias("log_t"))
