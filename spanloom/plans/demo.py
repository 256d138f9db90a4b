"""Annotated tables derived from documents by hash draws, so that every operator has input and SQL can derive the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.prob import unit
from spanloom.functions.text import word_runs
from spanloom.schema import OUTCOMES, PII_TYPES
from spanloom.session import stash, table


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def runs(spark: SparkSession, sf: str, word: bool = False) -> DataFrame:
    return word_runs(documents(spark, sf), word)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _stored(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is stored once a session and folder, as many queries read it."""
    key = spark.sparkContext.applicationId, sf, name
    if key not in _STORED:
        _STORED[key] = stash(make(), name)
    return _STORED[key]


def world(spark: SparkSession, sf: str, system: str = "a") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, gold, predictions)."""
    r = runs(spark, sf)  # made from the texts where it is read: its rows are as many as all words
    drawn = r
    if (spark.sparkContext.applicationId, sf, "gold") not in _STORED:  # both come from one pass over the words
        drawn = _stored(spark, sf, f"drawn-{system}", lambda: r.where((_u("gold") < 0.06) | (_u(f"{system}-false") < 0.02)))
    g = _stored(spark, sf, "gold", lambda: gold_of(drawn))
    return r.select("doc_id", "idx", "start", "end"), g, _stored(spark, sf, f"preds-{system}", lambda: preds_of(drawn, g, system))


def _u(salt: str) -> Column:
    return unit(salt, F.col("doc_id"), F.col("idx"))


def named(index: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), index.cast("int"))


def gold_of(r: DataFrame) -> DataFrame:
    """(doc_id, idx, pos, start, end, label, k) on 6% of the runs; some also take the next run."""
    g = r.where(_u("gold") < 0.06).withColumn("k", F.least(F.lit(10), F.floor(_u("label") * 11)).cast("int"))
    end = F.when((_u("wide") < 0.3) & F.col("next_end").isNotNull(), F.col("next_end")).otherwise(F.col("end"))
    return g.select("doc_id", "idx", F.col("idx").alias("pos"), "start", end.alias("end"), named(F.col("k"), OUTCOMES).alias("label"), "k")


def preds_of(r: DataFrame, gold: DataFrame, system: str) -> DataFrame:
    """(doc_id, start, end, label, score): three in four gold spans, some shifted or mistyped, and 2% of all runs."""
    shifted = F.col("start") + F.when((_u(f"{system}-shift") < 0.15) & (F.col("end") - F.col("start") > 1), 1).otherwise(0)
    kind = F.pmod(F.col("k") + F.when(_u(f"{system}-mistype") < 0.2, 1).otherwise(0), F.lit(9))
    hit = gold.where(_u(f"{system}-hit") < 0.75).select("doc_id", shifted.alias("start"), "end", named(kind, PII_TYPES).alias("label"), (F.floor((_u(f"{system}-score") * 0.7 + 0.3) * 1000) / 1000).alias("score"))
    false = r.where(_u(f"{system}-false") < 0.02).select("doc_id", "start", "end", named(F.least(F.lit(8), F.floor(_u(f"{system}-kind") * 9)), PII_TYPES).alias("label"), (F.floor(_u(f"{system}-low") * 0.6 * 1000) / 1000).alias("score"))
    return hit.unionByName(false)


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "gold", lambda: gold_of(runs(spark, sf)))


def preds(spark: SparkSession, sf: str, system: str = "a") -> DataFrame:
    return world(spark, sf, system)[2]


def scored_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, label, score, target): a drawn score for each labelled document, target its quality."""
    d = table(spark, sf, "labels").join(documents(spark, sf).select("doc_id", "lang"), "doc_id")
    u = unit("doc", F.col("doc_id"))
    return d.select("doc_id", F.col("lang").alias("label"), (F.floor((u * 0.6 + F.col("quality") * 0.4) * 1000) / 1000).alias("score"), F.col("quality").alias("target"))


# The same in SQL -----------------------------------------------------------------------------------------------------

_PIECES = r"regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+')"


def u(salt: str, *keys: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', '{salt}', {', '.join(keys or ('doc_id', 'idx'))})), 1, 8))::BIGINT / 4294967295e0)"


def pick(index: str, names: tuple[str, ...]) -> str:
    return f"([{', '.join(repr(x) for x in names)}])[({index}) + 1]"


RUNS = f"""pieces AS (SELECT doc_id, unnest(p) piece, unnest(range(len(p))) pos FROM (SELECT doc_id, {_PIECES} p FROM documents)),
offs AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT s FROM pieces),
runs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 idx, s AS "start", s + length(piece) AS "end", piece word FROM offs WHERE regexp_matches(piece, '^[\\p{{L}}\\p{{N}}]'))"""
GOLD = f"""{RUNS},
nexts AS (SELECT *, lead("end") OVER (PARTITION BY doc_id ORDER BY idx) next_end FROM runs),
gold AS (SELECT doc_id, idx, idx pos, "start", CASE WHEN {u('wide')} < 0.3e0 AND next_end IS NOT NULL THEN next_end ELSE "end" END AS "end", {pick(f"least(10, floor({u('label')} * 11))::INT", OUTCOMES)} label, least(10, floor({u('label')} * 11))::INT k FROM nexts WHERE {u('gold')} < 0.06e0)"""


def preds_sql(s: str, name: str = "preds") -> str:
    return f"""{name} AS (
SELECT doc_id, "start" + CASE WHEN {u(s + '-shift')} < 0.15e0 AND "end" - "start" > 1 THEN 1 ELSE 0 END AS "start", "end", {pick(f"(k + CASE WHEN {u(s + '-mistype')} < 0.2e0 THEN 1 ELSE 0 END) % 9", PII_TYPES)} label, floor(({u(s + '-score')} * 0.7e0 + 0.3e0) * 1000) / 1000 score FROM gold WHERE {u(s + '-hit')} < 0.75e0
UNION ALL SELECT doc_id, "start", "end", {pick(f"least(8, floor({u(s + '-kind')} * 9))::INT", PII_TYPES)}, floor({u(s + '-low')} * 0.6e0 * 1000) / 1000 FROM runs WHERE {u(s + '-false')} < 0.02e0)"""


PII_LIST = ", ".join(repr(x) for x in PII_TYPES)
MERGED = f"""pii AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM gold WHERE label IN ({PII_LIST})),
isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, label ROWS UNBOUNDED PRECEDING) island FROM pii),
merged AS (SELECT doc_id, min("start") AS "start", max("end") AS "end", arg_min(label, ("start", -"end", label)) label FROM isl GROUP BY doc_id, island)"""
SCORED = f"""bins AS (SELECT r.doc_id, r.idx, max(1 + floor(least(p.score, 1e0) * 1000 + 1e-9))::BIGINT bin FROM runs r JOIN preds p ON r.doc_id = p.doc_id AND r."start" < p."end" AND r."end" > p."start" GROUP BY ALL),
touched AS (SELECT r.doc_id, r.idx, unnest(range(greatest(r."start", g."start"), least(r."end", g."end"))) ch, g.label, g.pos FROM runs r JOIN gold g ON r.doc_id = g.doc_id AND r."start" < g."end" AND r."end" > g."start" WHERE g.label <> 'NOT_PII'),
chars AS (SELECT doc_id, idx, ch, arg_min(label, (CASE WHEN label = 'IGNORE' THEN 1 ELSE 0 END, pos, label)) label FROM touched GROUP BY ALL),
per_run AS (SELECT doc_id, idx, count(*) FILTER (label <> 'IGNORE') n_pii, count(*) FILTER (label = 'IGNORE') n_ign FROM chars GROUP BY ALL),
scored AS (SELECT r.*, coalesce(b.bin, 0) bin, coalesce(n_pii, 0) n_pii, r."end" - r."start" - coalesce(n_pii, 0) - coalesce(n_ign, 0) n_non FROM runs r LEFT JOIN bins b USING (doc_id, idx) LEFT JOIN per_run USING (doc_id, idx))"""
CURVE = """grid AS (SELECT unnest(range(1, 1003)) bin),
hist AS (SELECT bin, sum(n_pii)::BIGINT n_pii, sum(n_non)::BIGINT n_non FROM scored GROUP BY bin),
ups AS (SELECT g.bin, sum(coalesce(n_pii, 0)) OVER (ORDER BY g.bin DESC) up, sum(coalesce(n_non, 0)) OVER (ORDER BY g.bin DESC) un FROM grid g LEFT JOIN hist USING (bin)),
curve AS (SELECT bin - 1 k, CASE WHEN bin = 1002 THEN 1e0 ELSE 1 - up / (SELECT sum(n_pii) FROM hist) END leak, CASE WHEN bin = 1002 THEN 0e0 ELSE un / (SELECT sum(n_non) FROM hist) END AS over_ FROM ups)"""
EVAL = f"{GOLD},\n{preds_sql('a')},\n{SCORED}"
