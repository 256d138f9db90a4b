"""Registered queries, one or more for each operator, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import prob, text
from spanloom.operators import audit, build, calibration, crf, detect, leak, questions, series, spans, splits, stats, taxonomy, vectors, windows
from spanloom.plans import demo
from spanloom.plans.demo import CURVE, EVAL, GOLD, MERGED, RUNS, documents, preds_sql, u
from spanloom.schema import span_fault
from spanloom.session import stash, table
from spanloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query; whole-number columns come out as bigint."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = f(spark, sf_dir)
            return d.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in d.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(d: DataFrame, *cols: str) -> DataFrame:
    return d.withColumns({c: F.round(c, 6) for c in cols})


def scored(spark: SparkSession, sf: str, system: str = "a") -> tuple[DataFrame, DataFrame]:
    """(runs with bin and lengths, gold); the runs are made from the texts where they are read."""
    _, g, p = demo.world(spark, sf, system)
    return leak.scored_texts(documents(spark, sf), p, g), g


def hist(spark: SparkSession, sf: str, system: str = "a") -> DataFrame:
    return stash(leak.histograms(scored(spark, sf, system)[0]), "hist")


# Text kernel ---------------------------------------------------------------------------------------------------------


@query(f"WITH {RUNS} SELECT doc_id, count(*) n_runs, sum(\"end\" - \"start\")::BIGINT n_alnum, max(\"end\" - \"start\") longest, min(\"start\") first_start, max(\"end\") last_end FROM runs GROUP BY doc_id")
def doc_runs(spark, sf):
    n = F.col("end") - F.col("start")
    return demo.runs(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.sum(n).alias("n_alnum"), F.max(n).alias("longest"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


@query(r"SELECT lang, source, count(*) docs, sum(length(text))::BIGINT chars, sum(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')))::BIGINT alnum FROM documents GROUP BY lang, source")
def alnum_share(spark, sf):
    return documents(spark, sf).groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))).alias("alnum"))


@query(r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, p) m, string_split_regex(text, p) g FROM documents, (SELECT '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b' p) WHERE regexp_matches(text, p)),
o AS (SELECT doc_id, unnest(m) surface, unnest([list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) for i in range(1, len(m) + 1)])::BIGINT s FROM e)
SELECT doc_id, s AS "start", s + length(surface) AS "end", surface FROM o""")
def pii_email_spans(spark, sf):
    return detect.validated(documents(spark, sf), "email")


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) d FROM documents), k AS (SELECT doc_id, d FROM c WHERE length(d) BETWEEN 13 AND 19),
s AS (SELECT doc_id, d, list_sum([CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT WHEN substr(d, i, 1)::INT > 4 THEN 2 * substr(d, i, 1)::INT - 9 ELSE 2 * substr(d, i, 1)::INT END for i in range(1, length(d) + 1)]) n FROM k)
SELECT doc_id, d surface FROM s WHERE n % 10 = 0""")
def card_numbers(spark, sf):
    d = text.matches(documents(spark, sf), "[0-9]+").where(F.length("surface").between(13, 19))
    return d.where(text.luhn_ok(F.col("surface"))).select("doc_id", "surface")


@query()
def validator_spans(spark, sf):
    return detect.validator_spans(documents(spark, sf))


@query()
def redaction_share(spark, sf):
    """Share of letters and numbers under e-mail and card spans by language and source."""
    d = documents(spark, sf)
    p = detect.validator_spans(d, ("email", "card")).select("doc_id", "start", "end", "label", "score")
    s = leak.scored_texts(d, p, p.limit(0))
    n = F.col("end") - F.col("start")
    per = s.groupBy("doc_id").agg(F.sum(n).alias("alnum"), F.sum(F.when(F.col("bin") > 0, n).otherwise(0)).alias("hidden"))
    g = d.select("doc_id", "lang", "source").join(per, "doc_id").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("alnum").alias("alnum"), F.sum("hidden").alias("hidden"))
    return g.withColumn("share", F.round(F.col("hidden") / F.col("alnum"), 6))


_SHINGLES = r"""sh AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w FROM documents))"""


@query(f"WITH {_SHINGLES} SELECT doc_id, len(s) n_shingles FROM sh")
def shingle_counts(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(text.shingles(F.col("text"))).alias("n_shingles"))


@query("SELECT CASE WHEN length(text) < 1000 THEN '<1k' WHEN length(text) < 10000 THEN '1k-10k' ELSE '>10k' END bucket, count(*) docs, max(length(text)) longest FROM documents GROUP BY 1")
def length_buckets(spark, sf):
    return documents(spark, sf).groupBy(text.length_bucket(F.length("text")).alias("bucket")).agg(F.count("*").alias("docs"), F.max(F.length("text")).alias("longest"))


_DRIFT = f"""{GOLD}, moved AS (SELECT g.doc_id, g.idx, d.text, substr(d.text, (g."start" + 1)::INT, (g."end" - g."start")::INT) surface, greatest(0, g."start" + floor({u('drift')} * 9)::BIGINT - 4) s, g."end" - g."start" n FROM gold g JOIN documents d USING (doc_id)),
near AS (SELECT m.*, unnest(range(greatest(s - 8, 0), least(s + n + 8, length(text)) - n + 1)) i FROM moved m)"""


@query(f"""WITH {_DRIFT}, best AS (SELECT doc_id, idx, min((abs(i - s), i)) b FROM near WHERE substr(text, (i + 1)::INT, n::INT) = surface GROUP BY doc_id, idx)
SELECT m.doc_id, m.idx, CASE WHEN substr(text, (s + 1)::INT, n::INT) = surface THEN s ELSE b[2] END fixed, substr(text, (s + 1)::INT, n::INT) = surface same FROM moved m LEFT JOIN best USING (doc_id, idx)""".replace("min((abs(i - s), i)) b", "arg_min(i, (abs(i - s), i)) b").replace("b[2]", "b"))
def reanchored(spark, sf):
    """Spans shifted by up to four characters find their surface again."""
    s = F.greatest(F.lit(0), F.col("start") + F.floor(prob.unit("drift", F.col("doc_id"), F.col("idx")) * 9) - 4).cast("int")
    g = demo.gold(spark, sf).select("doc_id", "idx", "start", "end", s.alias("s"), (s + F.col("end") - F.col("start")).cast("int").alias("e"))
    g = text.neighbourhoods(documents(spark, sf), g, 8)
    fixed = text.reanchor(F.col("near"), F.col("s") - F.col("at"), F.col("e") - F.col("at"), F.col("surface"), 8)
    same = F.substring(F.col("near"), F.col("s") - F.col("at") + 1, F.col("e") - F.col("s")) == F.col("surface")
    return g.select("doc_id", "idx", (fixed["start"] + F.col("at")).alias("fixed"), same.alias("same"))


# Ingest --------------------------------------------------------------------------------------------------------------

_PARTS = """parts AS (SELECT conv_id, turn, role, text, CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END prefix, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END o FROM conversations WHERE text IS NOT NULL AND role IN ('system', 'user', 'assistant')),
placed AS (SELECT *, coalesce(sum(length(prefix) + length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, o, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT off FROM parts)"""


@query(f"WITH {_PARTS} SELECT conv_id, string_agg(prefix || text || chr(10), '' ORDER BY off) text, count(*) messages FROM placed GROUP BY conv_id")
def conversation_docs(spark, sf):
    return readers.conversations(table(spark, sf, "conversations")).select("conv_id", "text", F.size("ignore").alias("messages"))


@query(f"WITH {_PARTS} SELECT conv_id, off AS \"start\", off + length(prefix) AS \"end\" FROM placed")
def conversation_prefix_ranges(spark, sf):
    return readers.conversations(table(spark, sf, "conversations")).select("conv_id", F.explode("ignore").alias("x")).select("conv_id", "x.start", "x.end")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) t, unnest(range(len(string_split(text, ' ')))) pos, len(string_split(text, ' ')) n FROM documents),
o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT s, CASE WHEN pos % 7 = 2 THEN 'B-NAME' WHEN pos % 7 = 3 THEN 'I-NAME' WHEN pos % 11 = 5 THEN 'I-URL' ELSE 'O' END tag FROM w),
l AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END label FROM o), p AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) prev FROM l),
i AS (SELECT *, sum(CASE WHEN label IS NOT NULL AND (tag LIKE 'B-%' OR prev IS NULL OR prev <> label) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) island FROM p)
SELECT doc_id, min(s) AS "start", max(s + length(t))::BIGINT AS "end", min(label) label FROM i WHERE label IS NOT NULL GROUP BY doc_id, island""")
def token_spans(spark, sf):
    d = documents(spark, sf).withColumn("tokens", F.split("text", " "))
    tag = lambda i: F.when(i % 7 == 2, "B-NAME").when(i % 7 == 3, "I-NAME").when(i % 11 == 5, "I-URL").otherwise("O")
    d = d.select("doc_id", "tokens", F.transform("tokens", lambda t, i: F.lit(True)).alias("trailing_whitespace"), F.transform("tokens", lambda t, i: tag(i)).alias("ent_tags"))
    return readers.bio_spans(readers.token_rows(d))


_RAW = f"""{GOLD}, raw AS (SELECT g.doc_id, g.pos, d.text, g."start" + CASE WHEN {u('bad')} < 0.01e0 THEN 1000000 ELSE 0 END AS "start", g."end" + CASE WHEN {u('bad')} < 0.01e0 THEN 1000000 ELSE 0 END - CASE WHEN {u('cut')} < 0.1e0 AND g."end" - g."start" > 2 THEN 1 ELSE 0 END AS "end" FROM gold g JOIN documents d USING (doc_id)),
flag AS (SELECT *, "start" >= 0 AND "end" > "start" AND "end" <= length(text) ok FROM raw),
reach AS (SELECT *, max(CASE WHEN ok THEN "end" END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM flag)"""


def _raw(spark, sf):
    g = demo.gold(spark, sf)
    bad, cut = (prob.unit(s, F.col("doc_id"), F.col("idx")) for s in ("bad", "cut"))
    far = F.when(bad < 0.01, 1000000).otherwise(0)
    g = g.select("doc_id", "pos", (F.col("start") + far).alias("start"), (F.col("end") + far - F.when((cut < 0.1) & (F.col("end") - F.col("start") > 2), 1).otherwise(0)).alias("end"), "label")
    s = g.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", F.lit(None).cast("string").alias("surface"), F.lit("gold").alias("source")))).alias("spans"))
    return documents(spark, sf).select("doc_id", "text", F.col("source").alias("cluster_id")).join(s, "doc_id")


@query(rf"""WITH {_RAW}, c AS (SELECT count(*) spans, count(*) FILTER (NOT ok) out_of_range, 0::BIGINT surface_checked, 0::BIGINT surface_match,
count(*) FILTER (ok AND regexp_matches(substr(text, ("start" + 1)::INT, ("end" - "start")::INT), '^\s|\s$')) whitespace_edge,
count(*) FILTER (ok AND (("start" > 0 AND regexp_matches(substr(text, "start"::INT, 1), '[\p{{L}}\p{{N}}]') AND regexp_matches(substr(text, ("start" + 1)::INT, 1), '[\p{{L}}\p{{N}}]')) OR ("end" < length(text) AND regexp_matches(substr(text, "end"::INT, 1), '[\p{{L}}\p{{N}}]') AND regexp_matches(substr(text, ("end" + 1)::INT, 1), '[\p{{L}}\p{{N}}]')))) cuts_word,
count(*) FILTER (ok AND "start" < r) overlapping FROM reach)
SELECT name issue, value n FROM (UNPIVOT c ON COLUMNS(*))""")
def census(spark, sf):
    return build.census(_raw(spark, sf))


@query(f"""WITH {_RAW}, f AS (SELECT CASE WHEN "start" < 0 OR "end" <= "start" OR "end" > length(text) THEN 'offset out of range' END fault FROM raw) SELECT fault, count(*) n FROM f GROUP BY fault""")
def offset_faults(spark, sf):
    e = build.exploded(_raw(spark, sf))
    return e.groupBy(span_fault(F.col("text"), F.col("start"), F.col("end")).alias("fault")).agg(F.count("*").alias("n"))


_COURT = ("PERSON", "CODE", "LOC", "ORG", "DATETIME", "DEM", "QUANTITY", "MISC", "OTHER")


@query(f"""WITH {GOLD}, m AS (SELECT {demo.pick("least(8, floor(" + u('ent') + " * 9))::INT", _COURT)} e, {demo.pick("least(2, floor(" + u('idt') + " * 3))::INT", ("DIRECT", "QUASI", "NO_MASK"))} i FROM gold),
c AS (SELECT e, i, CASE e WHEN 'PERSON' THEN 'PERSON' WHEN 'LOC' THEN 'ADDRESS' WHEN 'DATETIME' THEN 'DATE' WHEN 'OTHER' THEN NULL ELSE 'OTHER_PII' END k FROM m)
SELECT e entity, i identifier, CASE WHEN i = 'NO_MASK' THEN 'NOT_PII' WHEN i = 'DIRECT' THEN k WHEN k IS NOT NULL THEN 'IGNORE' END canonical, count(*) n FROM c GROUP BY ALL""")
def court_labels(spark, sf):
    g = demo.gold(spark, sf)
    e = demo.named(F.least(F.lit(8), F.floor(prob.unit("ent", F.col("doc_id"), F.col("idx")) * 9)), _COURT)
    i = demo.named(F.least(F.lit(2), F.floor(prob.unit("idt", F.col("doc_id"), F.col("idx")) * 3)), ("DIRECT", "QUASI", "NO_MASK"))
    g = g.select(e.alias("entity"), i.alias("identifier"))
    return g.withColumn("canonical", taxonomy.court_label(F.col("entity"), F.col("identifier"))).groupBy("entity", "identifier", "canonical").agg(F.count("*").alias("n"))


def values(rows: list[tuple], *names: str) -> str:
    lit = lambda x: "NULL" if x is None else repr(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(x) for x in r) + ')' for r in rows)}) t({', '.join(names)}))"


_MAP = [(d, raw, out) for d, m in taxonomy.LABELS.items() for raw, out in m.items()]
_NEMO = tuple(raw for d, raw, _ in _MAP if d == "nemotron")


@query(f"""WITH {GOLD}, m AS (SELECT {demo.pick(f"least({len(_NEMO) - 1}, floor(" + u('raw') + f" * {len(_NEMO)}))::INT", _NEMO)} r FROM gold)
SELECT m.r AS raw, canonical, count(*) n FROM m JOIN {values([x for x in _MAP if x[0] == 'nemotron'], 'dataset', 'raw_', 'canonical')} d ON d.raw_ = m.r GROUP BY ALL""")
def mapped_labels(spark, sf):
    g = demo.gold(spark, sf)
    raw = demo.named(F.least(F.lit(len(_NEMO) - 1), F.floor(prob.unit("raw", F.col("doc_id"), F.col("idx")) * len(_NEMO))), _NEMO)
    return taxonomy.map_labels(g.select(F.lit("nemotron").alias("dataset"), raw.alias("raw")), spark).groupBy("raw", "canonical").agg(F.count("*").alias("n"))


_TREE = values(list(taxonomy.PARENTS.items()), "node", "parent")
_CLOSURE = f"tree AS {_TREE}, closure AS (SELECT node, node AS ancestor, 0 depth FROM tree UNION ALL SELECT c.node, t.parent, c.depth + 1 FROM closure c JOIN tree t ON c.ancestor = t.node WHERE t.parent IS NOT NULL)"



_LEAVES = tuple(sorted(set(taxonomy.PARENTS) - set(taxonomy.PARENTS.values())))


@query(f"""WITH RECURSIVE {_CLOSURE}, leaf AS (SELECT unnest({list(_LEAVES)!r}) raw), w AS (SELECT d.doc_id, raw, pow(-ln(1 - {u('mass', 'd.doc_id', 'raw')} * 0.999e0), 3) w FROM documents d, leaf),
p AS (SELECT doc_id, raw, w / sum(w) OVER (PARTITION BY doc_id) p FROM w), mass AS (SELECT doc_id, ancestor, sum(p) m FROM p JOIN closure ON raw = node GROUP BY ALL), lev AS (SELECT node, max(depth) l FROM closure GROUP BY node),
ok AS (SELECT doc_id, ancestor, m, l FROM mass JOIN lev ON ancestor = node WHERE m >= 0.15e0 OR l = 0)
SELECT doc_id id, arg_min(ancestor, (-l, -m, ancestor)) node, round(arg_min(m, (-l, -m, ancestor)), 6) mass FROM ok GROUP BY doc_id""")
def backed_off(spark, sf):
    """Drawn leaf probabilities of each document back off to the deepest node with mass 0.15."""
    leaf = F.array(*[F.lit(x) for x in _LEAVES])
    d = documents(spark, sf).select(F.col("doc_id").alias("id"), F.explode(leaf).alias("raw"))
    from pyspark.sql import Window

    w = F.pow(-F.log(1 - prob.unit("mass", F.col("id"), F.col("raw")) * 0.999), F.lit(3.0))
    d = d.withColumn("w", w).withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("id")))
    nodes = spark.createDataFrame([(x, x) for x in _LEAVES], "raw string, node string")
    return rounded(taxonomy.back_off(d.select("id", "raw", "p"), nodes, taxonomy.label_closure(taxonomy.label_tree(spark)), 0.15), "mass")


# Span algebra --------------------------------------------------------------------------------------------------------


@query(f"WITH {GOLD}, {MERGED} SELECT * FROM merged")
def merged_gold(spark, sf):
    return spans.merged_gold(demo.gold(spark, sf))


@query(f"""WITH {GOLD}, twice AS (SELECT doc_id, "start", "end", label, pos FROM gold UNION ALL SELECT doc_id, "start", "end", label, pos + 100000 FROM gold WHERE pos % 3 = 0) SELECT doc_id, "start", "end", label, min(pos) pos FROM twice GROUP BY doc_id, "start", "end", label""")
def deduped_spans(spark, sf):
    g = demo.gold(spark, sf).select("doc_id", "start", "end", "label", "pos")
    return spans.dedupe(g.unionByName(g.where("pos % 3 = 0").withColumn("pos", F.col("pos") + 100000)))


@query(f"""WITH {GOLD}, {preds_sql('a')}, {preds_sql('b', 'more')}, d AS (SELECT *, 0 win FROM preds UNION ALL SELECT *, 1 FROM more), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "start", "end", label ORDER BY score DESC, win) n FROM d)
SELECT doc_id, "start", "end", label, score, win::BIGINT win FROM r WHERE n = 1""")
def stitched(spark, sf):
    r, g, p = demo.world(spark, sf)
    d = p.withColumn("win", F.lit(0)).unionByName(demo.preds_of(r, g, "b").withColumn("win", F.lit(1))).withColumn("pos", F.lit(0))
    return spans.stitch(d).drop("pos")


@query(f"""WITH {GOLD}, {preds_sql('a')}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", label) - 1 i FROM preds), o AS (SELECT doc_id, "start" < max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) x FROM s)
SELECT doc_id, count(*) FILTER (x) overlapping FROM o GROUP BY doc_id""")
def overlap_counts(spark, sf):
    return spans.kept_overlaps(demo.preds(spark, sf))


# Spans in order of score; each is kept unless it overlaps one kept before.
_GREEDY = """o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, "start", "end", label) n FROM preds),
walk AS (SELECT doc_id, n, [{'s': "start", 'e': "end", 'l': label, 'c': score}] k FROM o WHERE n = 1
UNION ALL SELECT o.doc_id, o.n, CASE WHEN len([x for x in w.k if o."start" < x.e AND o."end" > x.s]) = 0 THEN list_append(w.k, {'s': o."start", 'e': o."end", 'l': o.label, 'c': o.score}) ELSE w.k END FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1),
kept AS (SELECT doc_id, unnest(k) x FROM (SELECT doc_id, arg_max(k, n) k FROM walk GROUP BY doc_id))"""


@query(f"WITH RECURSIVE {GOLD}, {preds_sql('a')}, {_GREEDY} SELECT doc_id, x.s AS \"start\", x.e AS \"end\", x.l label, x.c score FROM kept")
def suppressed(spark, sf):
    return spans.suppress(demo.preds(spark, sf))


@query(f"""WITH {GOLD}, {preds_sql('a')}, m AS (SELECT p.doc_id, p."start", p."end", g.label, least(p."end", g."end") - greatest(p."start", g."start") o FROM preds p JOIN gold g ON p.doc_id = g.doc_id AND p."start" < g."end" AND p."end" > g."start")
SELECT doc_id, "start", "end", arg_max(label, (o, 1e0, label)) label FROM m GROUP BY doc_id, "start", "end" """)
def best_overlap_label(spark, sf):
    r, g, p = demo.world(spark, sf)
    return spans.best_overlap(p.select("doc_id", "start", "end"), g.withColumn("score", F.lit(1.0)))


@query(f"""WITH {GOLD}, {preds_sql('a')}, w AS (SELECT p.doc_id, p."start", p."end", least(p."start", min(r."start")) wide_start, greatest(p."end", max(r."end")) wide_end FROM (SELECT DISTINCT doc_id, "start", "end" FROM preds) p JOIN runs r ON p.doc_id = r.doc_id AND p."start" < r."end" AND p."end" > r."start" GROUP BY p.doc_id, p."start", p."end")
SELECT doc_id, count(DISTINCT (wide_start, wide_end)) n, sum(wide_start)::BIGINT s, sum(wide_end)::BIGINT e FROM w GROUP BY doc_id""")
def expanded_to_words(spark, sf):
    p = demo.preds(spark, sf)
    w = leak.expanded_texts(documents(spark, sf), p.select("doc_id", "start", "end").distinct())
    return w.groupBy("doc_id").agg(F.countDistinct("wide_start", "wide_end").alias("n"), F.sum("wide_start").alias("s"), F.sum("wide_end").alias("e"))


@query(f"""WITH {GOLD}, {preds_sql('a')}, {MERGED}, p AS (SELECT * FROM preds WHERE score >= 0.5e0), tp AS (SELECT doc_id, count(*) tp FROM merged m WHERE EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND p."start" = m."start" AND p."end" = m."end" AND p.label = m.label) GROUP BY doc_id),
fr AS (SELECT doc_id, count(*) free FROM p WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE p.doc_id = m.doc_id AND p."start" < m."end" AND p."end" > m."start") AND EXISTS (SELECT 1 FROM gold m WHERE m.label = 'IGNORE' AND p.doc_id = m.doc_id AND p."start" < m."end" AND p."end" > m."start") GROUP BY doc_id),
np AS (SELECT doc_id, count(*) n FROM p GROUP BY 1), ng AS (SELECT doc_id, count(*) n FROM merged GROUP BY 1),
c AS (SELECT coalesce(tp, 0) tp, coalesce(np.n, 0) - coalesce(tp, 0) - coalesce(free, 0) fp, coalesce(ng.n, 0) - coalesce(tp, 0) fn FROM np FULL JOIN ng USING (doc_id) LEFT JOIN tp USING (doc_id) LEFT JOIN fr USING (doc_id)),
s AS (SELECT sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn FROM c)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1 FROM s""")
def span_prf_strict(spark, sf):
    r, g, p = demo.world(spark, sf)
    c = spans.matched_counts(p.where("score >= 0.5").select("doc_id", "start", "end", "label"), g, True, "strict")
    return rounded(spans.prf(c), "precision", "recall", "f1")


# Gold spans in order; each takes the waiting prediction whose last gold span comes first.
_WALK = """mg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start") g FROM merged), pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", label) n FROM p),
sp AS (SELECT pr.doc_id, pr.n, min(g) lo, max(g) hi FROM pr JOIN mg ON pr.doc_id = mg.doc_id AND pr."start" < mg."end" AND pr."end" > mg."start" GROUP BY ALL), ls AS (SELECT doc_id, list({'hi': hi, 'n': n, 'lo': lo}) ps, max(hi) last FROM sp GROUP BY doc_id),
walk AS (SELECT doc_id, 0::BIGINT g, []::BIGINT[] used FROM ls UNION ALL SELECT doc_id, g + 1, CASE WHEN len(c) > 0 THEN list_append(used, c[1].n) ELSE used END FROM (SELECT w.doc_id, w.g, w.used, list_sort([x for x in ls.ps if x.lo <= w.g + 1 AND x.hi >= w.g + 1 AND NOT list_contains(w.used, x.n)]) c FROM walk w JOIN ls USING (doc_id) WHERE w.g < ls.last) z),
tp AS (SELECT doc_id, max(len(used)) tp FROM walk GROUP BY doc_id),"""
_STRICT = ORACLE_SQL["span_prf_strict"]


@query(_STRICT[:_STRICT.index("tp AS (")].replace("WITH ", "WITH RECURSIVE ", 1) + _WALK + _STRICT[_STRICT.index("\nfr AS ("):])
def span_prf_partial(spark, sf):
    r, g, p = demo.world(spark, sf)
    c = spans.matched_counts(p.where("score >= 0.5").select("doc_id", "start", "end", "label"), g, False, "partial")
    return rounded(spans.prf(c), "precision", "recall", "f1")


@query(f"""WITH {GOLD}, {preds_sql('a')}, p AS (SELECT DISTINCT doc_id, "start", "end", label FROM preds WHERE score >= 0.5e0), g AS (SELECT DISTINCT doc_id, "start", "end", label FROM gold),
j AS (SELECT coalesce(p.label, g.label) label, p.doc_id x, g.doc_id y FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p."start" = g."start" AND p."end" = g."end" AND p.label = g.label)
SELECT label, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) tp, count(*) FILTER (y IS NULL) fp, count(*) FILTER (x IS NULL) fn FROM j GROUP BY label""")
def typed_counts(spark, sf):
    r, g, p = demo.world(spark, sf)
    return spans.typed_counts(p.where("score >= 0.5"), g)


@query(f"""WITH {GOLD}, {preds_sql('a')}, b AS (SELECT doc_id, "start", "end", arg_max(label, (score, label)) said FROM preds GROUP BY ALL) SELECT count(*) n, count(said) matched, count(*) FILTER (said = label) AS "right" FROM gold LEFT JOIN b USING (doc_id, "start", "end")""")
def gold_typing(spark, sf):
    r, g, p = demo.world(spark, sf)
    return spans.gold_typing(p, g)


# Splits and samples --------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT source, row_number() OVER (ORDER BY sha256('calib-v1|' || source)) r, count(*) OVER () n FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, source, CASE WHEN r <= greatest(1, round_even(0.2e0 * n, 0)) THEN 'calib' ELSE 'test' END part FROM documents JOIN c USING (source)""")
def hash_split(spark, sf):
    return splits.hash_split(documents(spark, sf), "source", 0.2, "calib-v1").select("doc_id", "source", "part")


@query("""WITH s AS (SELECT lang, count(*) n, 150 * count(*) / (SELECT count(*) FROM documents) q FROM documents GROUP BY lang), a AS (SELECT *, floor(q) b, row_number() OVER (ORDER BY q - floor(q) DESC, lang) r FROM s), k AS (SELECT lang, b + CASE WHEN r <= 150 - (SELECT sum(floor(q)) FROM s) THEN 1 ELSE 0 END take FROM a),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('sample-v1|' || doc_id)) r FROM documents) SELECT doc_id, lang FROM d JOIN k USING (lang) WHERE r <= take""")
def stratified_sample(spark, sf):
    return splits.stratified_sample(documents(spark, sf), 150, "lang", "sample-v1").select("doc_id", "lang")


@query(f"SELECT doc_id, {u('dev-v1', 'doc_id')} < 0.02e0 in_dev FROM documents")
def dev_slice(spark, sf):
    return splits.dev_slice(documents(spark, sf), F.col("doc_id"), 0.02, "dev-v1").select("doc_id", "in_dev")


@query("""WITH s AS (SELECT source, count(*) n, sha256('clusters-v1:' || source) h FROM documents GROUP BY source), b AS (SELECT source, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM s) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM b WHERE before < 120)""")
def cluster_sample(spark, sf):
    return splits.cluster_sample(documents(spark, sf), "source", 120, "clusters-v1").select("doc_id", "source")


@query(f"""WITH c AS (SELECT lang, count(*) n FROM documents GROUP BY lang), k AS (SELECT doc_id, lang, -ln(greatest({u('draw-v1:0', 'doc_id')}, 1e-300)) * n ** 0.5e0 key FROM documents JOIN c USING (lang)) SELECT doc_id, lang FROM k ORDER BY key, doc_id LIMIT 100""")
def weighted_draw(spark, sf):
    return splits.draw(documents(spark, sf).select("doc_id", "lang"), 100, "lang", "doc_id", "draw-v1").select("doc_id", "lang")


@query("""WITH o AS (SELECT item_id, row_number() OVER (ORDER BY sha256('again-v1|' || item_id), item_id) - 1 r, count(*) OVER () n FROM benchmark) SELECT item_id, s slot FROM o, (SELECT unnest(range(500)) s) WHERE s % n = r""")
def repeated_rows(spark, sf):
    return splits.repeated(table(spark, sf, "benchmark").select("item_id"), 500, "item_id", "again-v1")


@query(f"""WITH {GOLD}, {preds_sql('a')}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, "start", "end", label) n, greatest(count(*) OVER (PARTITION BY doc_id) - 5, 0) dropped FROM preds) SELECT doc_id, "start", "end", label, score, dropped FROM r WHERE n <= 5""")
def top_candidates(spark, sf):
    return splits.top_k(demo.preds(spark, sf), 5, ["doc_id"], [F.col("score").desc(), F.col("start"), F.col("end"), F.col("label")])


@query("""WITH b AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM documents) SELECT floor(b / 50000)::BIGINT batch, count(*) docs, sum(n_chars)::BIGINT chars FROM b GROUP BY 1""")
def token_batches(spark, sf):
    return splits.token_batches(documents(spark, sf), "doc_id", "n_chars", 50000).groupBy("batch").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


# Leakage audit -------------------------------------------------------------------------------------------------------


@query("SELECT sha256(text) digest, count(*) n, min(doc_id) AS \"first\" FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(spark, sf):
    return audit.exact_groups(documents(spark, sf))


_ROWS = f"{_SHINGLES}, sr AS (SELECT doc_id, len(s) n, unnest(s) h FROM sh)"


@query(f"""WITH {_ROWS}, f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) f FROM documents), o AS (SELECT * FROM sr WHERE doc_id IN (SELECT f FROM f)),
p AS (SELECT a.doc_id test_id, b.doc_id train_id, a.n an, b.n bn, count(*) c FROM o a JOIN o b USING (h) WHERE a.doc_id > b.doc_id GROUP BY ALL)
SELECT test_id, train_id, round(c / (an + bn - c), 6) jaccard FROM p WHERE c / (an + bn - c) >= 0.8e0 UNION ALL SELECT doc_id, f, 1e0 FROM f WHERE doc_id <> f""")
def near_dups_jaccard(spark, sf):
    """Pairs of different texts by the first document of each, and copies with theirs."""
    one, members = audit.folded(documents(spark, sf).select("doc_id", "text"))
    pairs = rounded(audit.similar_pairs(one, one, 0.8, self_join=True), "jaccard")
    return pairs.unionByName(members.where("doc_id <> first").select(F.col("doc_id").alias("test_id"), F.col("first").alias("train_id"), F.lit(1.0).alias("jaccard")))


_SKEL = f"""{GOLD}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, label) n FROM gold),
walk AS (SELECT doc_id, n, "start", "end", label, true keep, "end" upto FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.n, o."start", o."end", o.label, o."start" >= w.upto, CASE WHEN o."start" >= w.upto THEN o."end" ELSE w.upto END FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1),
kept AS (SELECT * FROM walk WHERE keep), seg AS (SELECT k.*, d.text, coalesce(lag(k."end") OVER (PARTITION BY k.doc_id ORDER BY k."start"), 0) prev FROM kept k JOIN documents d USING (doc_id)),
joined AS (SELECT doc_id, string_agg(substr(text, (prev + 1)::INT, ("start" - prev)::INT) || '<' || label || '>', '' ORDER BY "start") t, max("end") last FROM seg GROUP BY doc_id),
skel AS (SELECT d.doc_id, d.source, lower(trim(regexp_replace(regexp_replace(coalesce(t, '') || substr(d.text, (coalesce(last, 0) + 1)::INT), '\\p{{Nd}}', '0', 'g'), '\\s+', ' ', 'g'))) skeleton FROM documents d LEFT JOIN joined USING (doc_id))"""


@query(f"WITH RECURSIVE {_SKEL} SELECT doc_id, sha256(skeleton) digest FROM skel")
def skeletons(spark, sf):
    return audit.with_skeletons(documents(spark, sf).select("doc_id", "text"), demo.gold(spark, sf)).select("doc_id", F.sha2("skeleton", 256).alias("digest"))


def _halves(spark, sf):
    d = documents(spark, sf).select("doc_id", "text", F.col("source").alias("cluster_id"))
    d = stash(audit.with_skeletons(d, demo.gold(spark, sf).where("label = 'EMAIL'")), "skeletons")
    half = prob.unit("half", F.col("doc_id")) < 0.5
    return d.where(half), d.where(~half)


def _near_sql(name: str, text: str, share: str) -> str:
    """Test halves near train halves, by different texts, from an inverted index of shingles: {name}(doc_id, ids)."""
    return rf"""{name}_f AS MATERIALIZED (SELECT doc_id, test, min(doc_id) OVER (PARTITION BY test, {text}) f FROM halves), {name}_w AS MATERIALIZED (SELECT doc_id, halves.test, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+') w FROM halves JOIN {name}_f USING (doc_id) WHERE doc_id = f),
{name}_s AS MATERIALIZED (SELECT doc_id, test, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))] ELSE list_distinct([hash(array_to_string(w[i:i + 4], ' ')) for i in range(1, len(w) - 3)]) END s FROM {name}_w), {name}_r AS MATERIALIZED (SELECT doc_id, test, len(s) n, unnest(s) h FROM {name}_s),
{name}_p AS (SELECT a.doc_id x, b.doc_id y, a.n an, b.n bn, count(*) c FROM {name}_r a JOIN {name}_r b ON a.h = b.h AND a.test AND NOT b.test AND a.n >= {share} * b.n - 1e-9 AND b.n >= {share} * a.n - 1e-9 GROUP BY ALL),
{name}_l AS (SELECT x, list_sort(list(y))[1:5] ids FROM {name}_p WHERE c / (an + bn - c) >= {share} GROUP BY x), {name} AS MATERIALIZED (SELECT {name}_f.doc_id, array_to_string(ids, ',') ids FROM {name}_f JOIN {name}_l ON f = x WHERE test)"""


_SKEL_EMAIL = _SKEL.replace("FROM gold), walk", "FROM gold WHERE label = 'EMAIL'), walk").replace("FROM gold),\nwalk", "FROM gold WHERE label = 'EMAIL'),\nwalk")
_FLAGGED = f"""{_SKEL_EMAIL}, halves AS MATERIALIZED (SELECT k.doc_id, d.text, k.skeleton, d.source, {u('half', 'k.doc_id')} >= 0.5e0 test FROM skel k JOIN documents d USING (doc_id)), {_near_sql('near', 'text', '0.8e0')}, {_near_sql('tmpl', 'skeleton', '0.9e0')},
flagged AS MATERIALIZED (SELECT h.doc_id, source cluster_id, coalesce(near.ids, '') near, h.skeleton IN (SELECT skeleton FROM halves WHERE NOT test) same_skeleton, coalesce(tmpl.ids, '') template FROM halves h LEFT JOIN near USING (doc_id) LEFT JOIN tmpl USING (doc_id) WHERE h.test AND (near.ids IS NOT NULL OR tmpl.ids IS NOT NULL OR h.skeleton IN (SELECT skeleton FROM halves WHERE NOT test)))"""


@query(f"WITH RECURSIVE {_FLAGGED} SELECT * FROM flagged")
def audit_flagged(spark, sf):
    """One half by hash against the other, two sides of a split."""
    return audit.audit(*_halves(spark, sf)).withColumns({c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")) for c in ("near", "template")})


@query(f"""WITH RECURSIVE {_FLAGGED}, t AS (SELECT doc_id, source c FROM halves WHERE test), stay AS (SELECT * FROM t WHERE c NOT IN (SELECT cluster_id FROM flagged) AND doc_id NOT IN (SELECT doc_id FROM flagged))
SELECT (SELECT count(*) FROM t) n_test, (SELECT count(*) FROM flagged) n_flagged, ((SELECT count(*) FROM t) - (SELECT count(*) FROM stay)) / (SELECT count(*) FROM t) dropped_docs, ((SELECT count(DISTINCT c) FROM t) - (SELECT count(DISTINCT c) FROM stay)) / (SELECT count(DISTINCT c) FROM t) dropped_clusters""")
def audit_report(spark, sf):
    train, test = _halves(spark, sf)
    return audit.report(test, stash(audit.audit(train, test), "flagged"))


@query(r"""WITH di AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w FROM documents) WHERE len(w) >= 5),
bi AS (SELECT item_id, list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) s FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w FROM benchmark) WHERE len(w) >= 5),
b AS (SELECT item_id, len(s) n, unnest(s) h FROM bi), d AS (SELECT doc_id, unnest(s) h FROM di) SELECT doc_id, item_id FROM d JOIN b USING (h) GROUP BY doc_id, item_id, n HAVING count(*) = n""")
def benchmark_contamination(spark, sf):
    return audit.contained_items(documents(spark, sf), table(spark, sf, "benchmark"))


# Leak and over-redaction ---------------------------------------------------------------------------------------------


@query(f"WITH {EVAL} SELECT doc_id AS cluster, bin, sum(n_pii)::BIGINT n_pii, sum(n_non)::BIGINT n_non FROM scored GROUP BY ALL HAVING sum(n_pii + n_non) > 0")
def cluster_hist(spark, sf):
    return leak.histograms(scored(spark, sf)[0])


@query(f"WITH {EVAL}, {CURVE} SELECT k, round(leak, 6) leak, round(over_, 6) AS \"over\" FROM curve")
def leak_curve(spark, sf):
    return rounded(leak.curve(hist(spark, sf)), "leak", "over")


@query(f"""WITH {EVAL}, {CURVE}, o AS (SELECT over_, min(leak) OVER (ORDER BY over_, leak ROWS UNBOUNDED PRECEDING) low, lead(over_) OVER (ORDER BY over_, leak) nxt FROM curve)
SELECT round(sum(low * (least(coalesce(nxt, 'inf'::DOUBLE), 0.05e0) - least(over_, 0.05e0))) / 0.05e0, 6) pauc FROM o""")
def pauc(spark, sf):
    return rounded(leak.pauc(leak.curve(hist(spark, sf))), "pauc")


@query(f"WITH {EVAL}, {CURVE} SELECT b::DOUBLE budget, round(min(leak), 6) leak FROM curve, (SELECT unnest([0.005, 0.01, 0.02, 0.05]) b) WHERE over_ <= b::DOUBLE + 1e-12 GROUP BY b")
def budget_leak(spark, sf):
    c = stash(leak.curve(hist(spark, sf)), "curve")
    out = None
    for b in leak.BUDGETS:
        one = leak.best_leak(c, b).select(F.lit(b).alias("budget"), "leak")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "leak")


@query(f"WITH {EVAL}, {CURVE} SELECT coalesce(min(k) FILTER (k <= 1000 AND over_ <= 0.01e0 + 1e-12) / 1000, 1.001e0) threshold FROM curve")
def tuned_threshold(spark, sf):
    return leak.tuned_threshold(leak.curve(hist(spark, sf)), 0.01)


_POINT = "sum(n_pii) FILTER (bin >= 501)::BIGINT tp, sum(n_pii) FILTER (bin < 501)::BIGINT fn, sum(n_non) FILTER (bin >= 501)::BIGINT fp, sum(n_non) FILTER (bin < 501)::BIGINT tn"


@query(f"WITH {EVAL}, c AS (SELECT {_POINT} FROM scored) SELECT tp, fn, fp, tn, round(tp / (tp + fp), 6) \"precision\", round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1, round(fn / (tp + fn), 6) leak, round(fp / (fp + tn), 6) AS \"over\" FROM c")
def operating_point(spark, sf):
    return rounded(leak.at_threshold(hist(spark, sf), 0.5), "precision", "recall", "f1", "leak", "over")


@query(f"WITH {EVAL}, b AS (SELECT s.*, CASE WHEN length(text) < 1000 THEN '<1k' WHEN length(text) < 10000 THEN '1k-10k' ELSE '>10k' END bucket FROM scored s JOIN documents USING (doc_id)), c AS (SELECT bucket, {_POINT} FROM b GROUP BY bucket) SELECT bucket, round(tp / (tp + fn), 6) recall FROM c")
def recall_by_length(spark, sf):
    _, g, p = demo.world(spark, sf)
    d = documents(spark, sf).withColumn("bucket", text.length_bucket(F.length("text")))
    b = leak.binned_texts(d, p, g, "bucket")
    return rounded(leak.at_threshold(b, 0.5, "bucket").select("bucket", "recall"), "recall")


_MASKS = f"{EVAL}, {MERGED}, masks AS (SELECT m.doc_id, m.\"start\", m.\"end\", m.label, bool_and(s.bin >= 501) masked FROM merged m JOIN scored s ON m.doc_id = s.doc_id AND m.\"start\" < s.\"end\" AND m.\"end\" > s.\"start\" GROUP BY ALL)"


@query(f"WITH {_MASKS} SELECT count(*) FILTER (NOT masked) exposed, count(*) mentions FROM masks")
def span_exposure(spark, sf):
    _, g, p = demo.world(spark, sf)
    return leak.exposure(leak.mention_texts(documents(spark, sf), p, g, 0.5))


@query(f"""WITH {_MASKS}, k AS (SELECT m.*, replace(lower(trim(substr(d.text, (m."start" + 1)::INT, (m."end" - m."start")::INT))), 'ß', 'ss') key FROM masks m JOIN documents d USING (doc_id)), g AS (SELECT count(*) n, bool_and(masked) a, bool_or(masked) o FROM k GROUP BY doc_id, key HAVING count(*) >= 2)
SELECT count(*) AS "groups", count(*) FILTER (a) all_masked, count(*) FILTER (o) cond_den, count(*) FILTER (a AND o) cond_num FROM g""")
def consistency(spark, sf):
    _, g, p = demo.world(spark, sf)
    return leak.consistency(leak.mention_texts(documents(spark, sf), p, g, 0.5, surface=True))


@query(f"""WITH {EVAL}, c AS (SELECT c.label, count(*) support, count(*) FILTER (s.bin >= 501) masked FROM chars c JOIN scored s USING (doc_id, idx) WHERE c.label <> 'IGNORE' GROUP BY c.label) SELECT label, coalesce(support, 0) support, coalesce(masked, 0) masked, round(masked / support, 6) recall FROM (SELECT unnest({list(demo.PII_TYPES)!r}) label) LEFT JOIN c USING (label)""")
def type_recall(spark, sf):
    _, g, p = demo.world(spark, sf)
    return rounded(leak.typed_texts(documents(spark, sf), p, g, 0.5), "recall")


@query(f"WITH {EVAL} SELECT round(coalesce(sum(n_pii) FILTER (bin >= 1001), 0) / sum(n_pii), 6) top_pii, round(coalesce(sum(n_non) FILTER (bin >= 1001), 0) / sum(n_non), 6) top_non, round(coalesce(sum(n_pii) FILTER (bin >= 1), 0) / sum(n_pii), 6) scored_pii, round(coalesce(sum(n_non) FILTER (bin >= 1), 0) / sum(n_non), 6) scored_non FROM scored")
def saturation(spark, sf):
    return rounded(leak.saturation(hist(spark, sf)), "top_pii", "top_non", "scored_pii", "scored_non")


@query(f"""WITH {EVAL}, h AS (SELECT bin, sum(n_pii + n_non) n FROM scored GROUP BY bin), g AS (SELECT unnest(range(1, 501)) bin), r AS (SELECT g.bin, sum(coalesce(n, 0)) OVER (ORDER BY g.bin DESC) run FROM g LEFT JOIN h USING (bin)), l AS (SELECT coalesce(max(bin) FILTER (run > (1 - 0.95e0) * (SELECT sum(n) FROM h)), 0) + 1 lo FROM r)
SELECT lo::BIGINT lo, 501::BIGINT hi, coalesce(sum(n_pii) FILTER (bin < lo OR bin >= 501), 0)::BIGINT pii_kept, coalesce(sum(n_pii) FILTER (bin < lo), 0)::BIGINT pii_leaked, sum(n_pii)::BIGINT pii_total, coalesce(sum(n_non) FILTER (bin < lo OR bin >= 501), 0)::BIGINT non_kept, coalesce(sum(n_non) FILTER (bin >= 501), 0)::BIGINT non_over, sum(n_non)::BIGINT non_total FROM scored, l GROUP BY lo""")
def selective_band(spark, sf):
    h = hist(spark, sf)
    lo, hi = leak.band(h, 0.95, 0.5)
    return leak.selective(h, lo, hi).select(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), "*")


# Calibration ---------------------------------------------------------------------------------------------------------

_SD = f"sd AS (SELECT l.doc_id, d.lang label, floor(({u('doc', 'l.doc_id')} * 0.6e0 + quality * 0.4e0) * 1000) / 1000 score, quality target FROM labels l JOIN documents d USING (doc_id))"


# Candidate pairs by score, then IoU, then order; a pair is won if both of its spans are free.
_CANDIDATES = f"""{GOLD}, {preds_sql('a')}, {MERGED}, mg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start") g FROM merged), pr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", label, score DESC) p FROM preds WHERE score >= 0.05e0),
j AS (SELECT pr.doc_id, p, g, score, greatest(0, least(pr."end", mg."end") - greatest(pr."start", mg."start")) / (greatest(pr."end", mg."end") - least(pr."start", mg."start")) iou FROM pr JOIN mg ON pr.doc_id = mg.doc_id AND pr."start" < mg."end" AND pr."end" > mg."start"),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, iou DESC, p, g) n FROM j WHERE iou >= 0.5e0),
walk AS (SELECT doc_id, n, [p] ps, [g] gs FROM q WHERE n = 1 UNION ALL SELECT q.doc_id, q.n, CASE WHEN list_contains(w.ps, q.p) OR list_contains(w.gs, q.g) THEN w.ps ELSE list_append(w.ps, q.p) END, CASE WHEN list_contains(w.ps, q.p) OR list_contains(w.gs, q.g) THEN w.gs ELSE list_append(w.gs, q.g) END FROM walk w JOIN q ON q.doc_id = w.doc_id AND q.n = w.n + 1),
won AS (SELECT doc_id, unnest(ps) p FROM (SELECT doc_id, arg_max(ps, n) ps FROM walk GROUP BY doc_id)),
free AS (SELECT DISTINCT pr.doc_id, p FROM pr JOIN gold i ON i.doc_id = pr.doc_id AND i.label = 'IGNORE' AND pr."start" < i."end" AND pr."end" > i."start" WHERE NOT EXISTS (SELECT 1 FROM mg WHERE mg.doc_id = pr.doc_id AND pr."start" < mg."end" AND pr."end" > mg."start"))"""


@query(f"WITH RECURSIVE {_CANDIDATES} SELECT pr.doc_id, pr.\"start\", pr.\"end\", pr.label, pr.score, (won.p IS NOT NULL)::BIGINT target FROM pr ANTI JOIN free ON free.doc_id = pr.doc_id AND free.p = pr.p LEFT JOIN won ON won.doc_id = pr.doc_id AND won.p = pr.p")
def calibration_candidates(spark, sf):
    r, g, p = demo.world(spark, sf)
    return calibration.candidates(p, g)[0]


@query(f"WITH {_SD} SELECT label, round(avg((score - target) ** 2), 6) brier FROM sd GROUP BY label")
def brier(spark, sf):
    return rounded(calibration.brier(demo.scored_docs(spark, sf), "label"), "brier")


@query(f"WITH {_SD}, b AS (SELECT score, target, ntile(15) OVER (ORDER BY score, doc_id) b, count(*) OVER () n FROM sd), g AS (SELECT count(*) / max(n) w, avg(score) p, avg(target) y FROM b GROUP BY b) SELECT round(sum(w * abs(p - y)), 6) ece FROM g")
def adaptive_ece(spark, sf):
    return rounded(calibration.adaptive_ece(demo.scored_docs(spark, sf), "doc_id"), "ece")


@query(f"WITH {_SD}, g AS (SELECT count(*) k, avg(score) p, avg(target) y FROM sd GROUP BY least(floor(score * 15), 14)) SELECT round(sum(k * abs(p - y)) / sum(k), 6) ece FROM g")
def width_ece(spark, sf):
    return rounded(calibration.width_ece(demo.scored_docs(spark, sf)), "ece")


@query(f"WITH {_SD}, e AS (SELECT quantile_cont(score, [i / 15e0 for i in range(1, 15)]) q FROM sd), g AS (SELECT count(*) k, avg(score) p, avg(target) y FROM sd, e GROUP BY len([x for x in q if x <= score])) SELECT round(sum(k * abs(p - y)) / sum(k), 6) ece FROM g")
def quantile_ece(spark, sf):
    return rounded(calibration.quantile_ece(demo.scored_docs(spark, sf)), "ece")


@query(f"WITH {_SD}, c AS (SELECT avg(target) r FROM sd WHERE {u('half', 'doc_id')} < 0.5e0) SELECT round(1 - avg((score - target) ** 2) / avg((r - target) ** 2), 6) skill FROM sd, c WHERE {u('half', 'doc_id')} >= 0.5e0")
def brier_skill(spark, sf):
    """One half by hash against the base rate of the other."""
    s, half = demo.scored_docs(spark, sf), prob.unit("half", F.col("doc_id")) < 0.5
    return rounded(calibration.brier_skill(s.where(~half), s.where(half)), "skill")


@query(f"WITH {_SD}, r AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) i, count(*) OVER () n, sum(1 - target) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) e FROM sd) SELECT i, round(i / n, 6) coverage, round(e / i, 6) risk FROM r")
def risk_coverage(spark, sf):
    return rounded(calibration.risk_coverage(demo.scored_docs(spark, sf), "doc_id"), "coverage", "risk")


@query(f"WITH {_SD}, s AS (SELECT score, sum(target) p, sum(1 - target) n FROM sd GROUP BY score), b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) lower_ FROM s) SELECT round(sum(p * (lower_ + n / 2)) / (sum(p) * sum(n)), 6) auroc FROM b")
def auroc(spark, sf):
    return rounded(calibration.auroc(demo.scored_docs(spark, sf)), "auroc")


# Statistics and decisions --------------------------------------------------------------------------------------------

_FAMILY = f"f AS (SELECT source || '|' || lang AS name, source dataset, lang baseline, {u('p', 'source', 'lang')} ** 4 * 0.1e0 p, {u('d', 'source', 'lang')} - 0.9e0 diff FROM (SELECT DISTINCT source, lang FROM documents))"
_HOLM = "h AS (SELECT *, row_number() OVER (ORDER BY p, name) - 1 i, count(*) OVER () m FROM f), r AS (SELECT *, least(1e0, max((m - i) * p) OVER w) p_holm, min(CASE WHEN p <= 0.05e0 / (m - i) THEN 1 ELSE 0 END) OVER w = 1 reject FROM h WINDOW w AS (ORDER BY p, name ROWS UNBOUNDED PRECEDING))"


def _family(spark, sf):
    d = documents(spark, sf).select(F.col("source").alias("dataset"), F.col("lang").alias("baseline")).distinct()
    p, diff = prob.unit("p", F.col("dataset"), F.col("baseline")), prob.unit("d", F.col("dataset"), F.col("baseline"))
    return d.withColumn("p", F.pow(p, F.lit(4.0)) * 0.1).withColumn("diff", diff - 0.9)


@query(f"WITH {_FAMILY}, {_HOLM} SELECT name, round(p, 6) p, round(p_holm, 6) p_holm, reject FROM r")
def holm(spark, sf):
    f = _family(spark, sf).select(F.concat_ws("|", "dataset", "baseline").alias("name"), "p")
    return rounded(stats.holm(f), "p", "p_holm")


@query(f"WITH {_FAMILY}, {_HOLM}, d AS (SELECT dataset, bool_and(diff < 0 AND reject) win, count(*) k FROM r GROUP BY dataset) SELECT sum(k)::BIGINT family, coalesce(string_agg(dataset, ',' ORDER BY dataset) FILTER (win), '') won, count(*) FILTER (win) >= 2 holds FROM d")
def family_decision(spark, sf):
    return stats.decide(_family(spark, sf), needed=2).withColumn("won", F.array_join("won", ","))


# Vectors and labels --------------------------------------------------------------------------------------------------

_UNIT = "un AS (SELECT vec_id, label, [x / sqrt(list_sum([y::DOUBLE * y::DOUBLE for y in embedding])) for x in [z::DOUBLE for z in embedding]] v FROM embeddings)"


@query(f"WITH {_UNIT}, s AS (SELECT q.vec_id query_id, r.vec_id id, list_sum([q.v[i] * r.v[i] for i in range(1, len(q.v) + 1)]) c FROM un q JOIN un r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) n FROM s) SELECT query_id, id, round(c, 6) cosine, n \"rank\" FROM k WHERE n <= 3")
def cosine_top3(spark, sf):
    e = vectors.with_unit(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("id"), "unit")
    return rounded(vectors.nearest(e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), e, 3), "cosine")


@query(f"""WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) x FROM embeddings, (SELECT unnest(range(1, 65)) i) GROUP BY ALL), l AS (SELECT label, list(x ORDER BY i) v FROM m GROUP BY label), n AS (SELECT label, [x / sqrt(list_sum([y * y for y in v])) for x in v] v FROM l)
SELECT a.label::BIGINT id, round(max(list_sum([a.v[i] * b.v[i] for i in range(1, 65)])), 6) best FROM n a JOIN n b ON a.label <> b.label GROUP BY a.label""")
def max_sim_other_label(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    l = vectors.with_unit(m).select(F.col("label").alias("id"), F.col("label").alias("node"), "unit")  # noqa: E741
    return rounded(vectors.best_of_other_group(l), "best")


# Questions and answers -----------------------------------------------------------------------------------------------


def _gold_raw(spark, sf, runs=None):
    """Gold with native labels by draw, the held-out one among them."""
    g = demo.gold_of(runs if runs is not None else demo.runs(spark, sf))
    raw = demo.named(F.least(F.lit(len(_NEMO) - 1), F.floor(prob.unit("raw", F.col("doc_id"), F.col("idx")) * len(_NEMO))), _NEMO)
    return g.select("doc_id", "idx", "start", "end", "label", raw.alias("raw"))


@query(f"""WITH {GOLD}, g AS (SELECT *, {demo.pick(f"least({len(_NEMO) - 1}, floor(" + u('raw') + f" * {len(_NEMO)}))::INT", _NEMO)} raw FROM gold), b AS (SELECT DISTINCT doc_id FROM g WHERE raw IN ('cvv', 'ipv6')), n AS (SELECT d.doc_id, count(g.doc_id) n FROM documents d LEFT JOIN g USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM b) GROUP BY d.doc_id)
SELECT doc_id, 'noul' kind, (n > 0)::BIGINT target FROM n UNION ALL SELECT doc_id, 'score', least(4, n) FROM n""")
def document_questions(spark, sf):
    held = spark.createDataFrame([("cvv",), ("ipv6",)], "raw string")
    return questions.document_questions(documents(spark, sf), _gold_raw(spark, sf), held)


@query()
def span_questions(spark, sf):
    cand = prob.unit("cand", F.col("doc_id"), F.col("idx")) < 0.02
    drawn = stash(demo.runs(spark, sf).where((prob.unit("gold", F.col("doc_id"), F.col("idx")) < 0.06) | cand), "drawn")  # both come from one pass over the words
    g = stash(_gold_raw(spark, sf, drawn), "gold")
    held = spark.createDataFrame([("cvv",), ("ipv6",)], "raw string")
    labels = spark.createDataFrame([(x, taxonomy.NODE_OF.get(x, x)) for x in _NEMO], "raw string, node string")
    fit = taxonomy.compatible_pairs(labels, taxonomy.label_closure(taxonomy.label_tree(spark)))
    return questions.span_questions(g, drawn.where(cand).select("doc_id", "start", "end"), held, labels.join(held, "raw", "left_anti").select("raw"), fit, "q1").withColumn("options", F.array_join("options", "|"))


_PROBS = f"pr AS (SELECT doc_id, lang label, [{', '.join(u('q' + str(i), 'doc_id') for i in range(5))}] w, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END target FROM documents), an AS (SELECT *, [x / list_sum(w) for x in w] p FROM pr)"


def _answers(spark, sf):
    lang = F.create_map(*[F.lit(x) for kv in (("de", 0), ("en", 1), ("es", 2), ("fr", 3)) for x in kv])
    p = F.array(*[prob.unit(f"q{i}", F.col("doc_id")) for i in range(5)])
    return documents(spark, sf).select("doc_id", F.col("lang").alias("label"), F.lit("choice").alias("type"), F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", questions.NONE)]).alias("options"), F.array(*[F.lit(float(i)) for i in range(5)]).alias("values"), p.alias("probabilities"), lang[F.col("lang")].alias("target"))


@query(f"WITH {_PROBS}, c AS (SELECT doc_id, p, 1 + list_sum([CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END for x in p]) / ln(5e0) conf FROM an) SELECT doc_id, (['de', 'en', 'es', 'fr', '{questions.NONE}'])[list_position(p, list_max(p))] choice, round(conf, 6) confidence, conf < 0.1e0 abstained, CASE WHEN NOT conf < 0.1e0 THEN round(1 - p[5], 6) END redaction FROM c")
def answered(spark, sf):
    a = questions.redaction_score(questions.answers(_answers(spark, sf), 0.1))
    return rounded(a.select("doc_id", "choice", "confidence", "abstained", "redaction"), "confidence", "redaction")


@query(f"""WITH {_PROBS}, t AS (SELECT label, target, [exp(ln(greatest(x, 1e-30)) / 0.7e0) for x in p] e FROM an), s AS (SELECT label, target, [x / list_sum(e) for x in e] p FROM t), o AS (SELECT label, (list_position(p, list_max(p)) - 1 = target)::INT::DOUBLE ok, list_max(p) top FROM s),
b AS (SELECT count(*) k, avg(top) c, avg(ok) y FROM o GROUP BY least(floor(top * 15), 14)) SELECT round((SELECT avg(ok) FROM o), 6) micro, NULL::DOUBLE none_accuracy, round((SELECT avg(a) FROM (SELECT avg(ok) a FROM o GROUP BY label)), 6) macro, round((SELECT sum(k * abs(c - y)) / sum(k) FROM b), 6) ece""")
def probability_metrics(spark, sf):
    return rounded(questions.probability_metrics(_answers(spark, sf), 0.7), "micro", "none_accuracy", "macro", "ece")


@query(f"WITH {_PROBS}, o AS (SELECT label, (list_position(f, list_max(f)) - 1 = target)::INT::DOUBLE ok FROM (SELECT label, target, list_concat(p[1:4], [-1e0]) f FROM an)) SELECT round(avg(a), 6) macro FROM (SELECT avg(ok) a FROM o GROUP BY label)")
def forced_choice(spark, sf):
    return rounded(questions.forced_choice(_answers(spark, sf), 4), "macro")


_SAID = f"{_PROBS}, sa AS (SELECT label, (['de', 'en', 'es', 'fr', 'none'])[list_position(p, list_max(p))] said FROM an)"


def _said(spark, sf):
    return _answers(spark, sf).select("label", F.get(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "none")]), prob.argmax(F.col("probabilities"))).alias("said"))


@query(f"WITH {_SAID}, p AS (SELECT count(*) k, avg((said = label)::INT) a FROM sa GROUP BY label) SELECT sum(k)::BIGINT n, round(sum(k * a) / sum(k), 6) micro, round(avg(a), 6) macro, round(max(k) / sum(k), 6) majority FROM p")
def accuracy_summary(spark, sf):
    return rounded(questions.accuracy_summary(_said(spark, sf)), "micro", "macro", "majority")


@query(f"WITH {_SAID}, c AS (SELECT label, said, count(*) n FROM sa GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, said) \"rank\" FROM c) SELECT * FROM r WHERE \"rank\" <= 3")
def top_predictions(spark, sf):
    return questions.top_predictions(_said(spark, sf))


@query("WITH l AS (SELECT lang kind, source label, count(*) k FROM documents GROUP BY ALL), g AS (SELECT kind, sum(k)::BIGINT n, arg_max(label, (k, label)) dominant, max(k) top FROM l GROUP BY kind) SELECT kind, n, dominant, round(n / sum(n) OVER (), 6) share, round(top / n, 6) dominant_share FROM g")
def composition(spark, sf):
    return rounded(questions.composition(documents(spark, sf).select(F.col("lang").alias("kind"), F.col("source").alias("label"))), "share", "dominant_share")


@query("SELECT lang, source, doc_id, floor((row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1) / 16)::BIGINT AS \"window\" FROM documents")
def question_windows(spark, sf):
    d = documents(spark, sf).select("lang", "source", F.col("doc_id").alias("pos"))
    return questions.windows_of(d.select(F.col("lang").alias("doc_id"), F.col("source").alias("options"), F.lit("").alias("state"), "pos"), "state", 16).select(F.col("doc_id").alias("lang"), F.col("options").alias("source"), F.col("pos").alias("doc_id"), "window")


# Windows and decoding ------------------------------------------------------------------------------------------------

_TOK = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|\S"
_WINDOWS = rf"""tk AS (SELECT doc_id, text, regexp_extract_all(text, '(?:{_TOK})|\s+') p FROM documents), tp AS (SELECT doc_id, unnest(p) t, unnest(range(len(p))) pos FROM tk),
to_ AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT s FROM tp),
tt AS (SELECT doc_id, s, s + length(t) e, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 i, count(*) OVER (PARTITION BY doc_id) n FROM to_ WHERE NOT regexp_matches(t, '^\s')),
nw AS (SELECT doc_id, max(n) n, greatest(0, ceil((max(n) - 150) / 75))::BIGINT last FROM tt GROUP BY doc_id), ws AS (SELECT doc_id, n, last, unnest(range(last + 1)) win FROM nw),
wins AS (SELECT w.doc_id, w.win, CASE WHEN w.win = 0 THEN 0 ELSE a.s END AS "start", CASE WHEN w.win = w.last THEN length(d.text) ELSE b.e END AS "end" FROM ws w JOIN documents d USING (doc_id) JOIN tt a ON a.doc_id = w.doc_id AND a.i = w.win * 75 LEFT JOIN tt b ON b.doc_id = w.doc_id AND b.i = w.win * 75 + 149
UNION ALL SELECT doc_id, 0, 0, length(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM nw))"""


@query(f"WITH {_WINDOWS} SELECT * FROM wins")
def text_windows(spark, sf):
    return windows.text_windows(documents(spark, sf).select("doc_id", "text"))


@query(f"WITH {GOLD}, {_WINDOWS}, j AS (SELECT g.doc_id, g.\"start\", g.\"end\", w.win, NOT (g.\"start\" >= w.\"start\" AND g.\"end\" <= w.\"end\") o, abs(g.\"start\" + g.\"end\" - w.\"start\" - w.\"end\") f FROM gold g JOIN wins w USING (doc_id)) SELECT doc_id, \"start\", \"end\", arg_min(win, (o, f, win)) win FROM j GROUP BY doc_id, \"start\", \"end\"")
def nearest_window(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    return windows.nearest_window(demo.gold(spark, sf).select("doc_id", "start", "end"), windows.text_windows(d))


@query(f"WITH {GOLD}, {_WINDOWS} SELECT g.doc_id, w.win, count(*) n, count(*) FILTER (g.\"start\" < w.\"start\" OR g.\"end\" > w.\"end\") unknown FROM gold g JOIN wins w ON g.doc_id = w.doc_id AND g.\"start\" < w.\"end\" AND g.\"end\" > w.\"start\" GROUP BY ALL")
def clipped_targets(spark, sf):
    w = windows.text_windows(documents(spark, sf).select("doc_id", "text"))
    return windows.clipped(w, demo.gold(spark, sf)).groupBy("doc_id", "win").agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("unknown"))


def _emissions(spark, sf):
    """Scores of two types for every word of the whole text, drawn by hash, in order."""
    e = lambda i: F.array(*[F.pmod(F.xxhash64(F.lit(f"e{k}"), F.col("doc_id"), i), F.lit(100_000)) / 25_000 - 2 for k in range(9)])
    n = text.packed_runs(documents(spark, sf), "doc_id").select("doc_id", F.size("runs").alias("n")).where("n > 0")
    return n.select("doc_id", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), e).alias("emissions"))


@query()
def crf_spans(spark, sf):
    """Segments of all words of each document."""
    return crf.span_probabilities(_emissions(spark, sf), crf.Chain.of(2, step=np.zeros((9, 9))), floor=0.05)


@query()
def crf_path(spark, sf):
    return crf.decode(_emissions(spark, sf), crf.Chain.of(2)).select("doc_id", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


@query()
def propagated(spark, sf):
    return detect.propagate(documents(spark, sf), demo.world(spark, sf)[2])


# Series and totals ---------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS \"median\" FROM events")
def loss_rolling_median(spark, sf):
    e = table(spark, sf, "events")
    return rounded(series.rolling_median(e, "user_id", ["ts", "event_id"], "value", 7).select("user_id", "event_id", "median"), "median")


@query("""WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) step, value, median(value) OVER (PARTITION BY user_id) base FROM events), h AS (SELECT *, CASE WHEN value > base * 1.1e0 AND value - base > 0.25e0 THEN 1 ELSE 0 END hit FROM m),
r AS (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id ORDER BY step) run FROM h), g AS (SELECT user_id, run, min(step) "first" FROM r WHERE hit = 1 GROUP BY ALL HAVING count(*) >= 2) SELECT user_id, min("first") AS "first" FROM g GROUP BY user_id""")
def loss_departures(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").where("value is not null")
    w = Window.partitionBy("user_id")
    e = e.withColumn("step", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("base", F.percentile("value", F.lit(0.5)).over(w))
    return series.departures(e, "user_id", "step", "value", "base", 1.1, 0.25, 2)


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) i, count(*) OVER (PARTITION BY event_type) n FROM events WHERE value IS NOT NULL) SELECT event_type, value FROM r WHERE i = ceil(n * 0.95e0)")
def latency_p95(spark, sf):
    return series.nearest_rank(table(spark, sf, "events").where("value is not null"), "value", 0.95, "event_type")


@query("SELECT event_type, round(sum(value), 4) total, count(*) n FROM events GROUP BY event_type")
def stage_totals(spark, sf):
    return series.totals(table(spark, sf, "events"), "event_type", "value").withColumn("total", F.round("total", 4))


@query("WITH l AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) label), c AS (SELECT lang, count(*) n FROM documents GROUP BY lang) SELECT label, coalesce(n, 0) n, CASE WHEN coalesce(n, 0) < 110 THEN 'fail' WHEN coalesce(n, 0) < 200 THEN 'fallback' ELSE 'ok' END status FROM l LEFT JOIN c ON label = lang")
def label_census(spark, sf):
    names = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "label string")
    return series.census(documents(spark, sf), names, "lang", 110, 200)


@query("WITH e AS (SELECT user_id, event_type, count(*) c FROM events GROUP BY ALL) SELECT event_type k, sum(c)::BIGINT v FROM e GROUP BY event_type")
def merged_reports(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").count()
    reports = e.groupBy("user_id").agg(F.sum("count").alias("docs"), F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("counts"))
    return series.merged_counts(reports).select(F.explode("counts").alias("k", "v"))
