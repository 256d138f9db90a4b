"""Build step: mapping, validation, quarantine of whole records, census of raw annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import ALNUM
from spanloom.operators.taxonomy import map_labels
from spanloom.schema import span_fault


class RejectBudgetExceeded(ValueError):
    pass


def exploded(raws: DataFrame) -> DataFrame:
    return raws.select("doc_id", "text", "cluster_id", F.posexplode_outer("spans").alias("pos", "s")).select("doc_id", "text", "cluster_id", "pos", "s.*")


def build(raws: DataFrame, dataset: str, spark: SparkSession, budget: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(spans, rejects) of raws (doc_id, text, cluster_id, spans).

    An unmapped label stops the whole build, after all were counted. A record with any invalid span, and the later ones
    of equal doc_id, are rejected as a whole; more than the budget of them raises. Equal spans of one document count once.
    """
    first = raws.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.sha2(F.coalesce("text", F.lit("")), 256))))
    e = exploded(first.where("_n = 1")).withColumn("raw", F.col("label")).withColumn("dataset", F.lit(dataset))
    mapped = map_labels(e.where("raw is not null"), spark)
    fault = span_fault(F.col("text"), F.col("start"), F.col("end"), F.col("surface"), F.col("canonical"))
    faults = mapped.withColumn("error", fault).where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))
    twice = first.where("_n > 1").select("doc_id", F.lit("duplicate doc_id").alias("error"))
    rejects = faults.unionByName(twice)
    n, bad = raws.count(), rejects.count()
    if n and bad / n > budget:
        raise RejectBudgetExceeded(f"{dataset}: {bad} of {n} records rejected; budget {budget:.2%}")
    w = Window.partitionBy("doc_id", "start", "end", "canonical").orderBy("pos")
    good = mapped.join(faults, "doc_id", "left_anti").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return good.select("doc_id", "pos", "start", "end", F.col("canonical").alias("label"), "raw", "source", "surface"), rejects


def census(raws: DataFrame) -> DataFrame:
    """(issue, n): counts over all spans. A span out of range counts there and nowhere else."""
    e = exploded(raws).where("start is not null")
    cut = F.expr("substring(text, start + 1, end - start)")
    ok = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text"))
    w = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(ok, F.col("end"))).over(w)
    edge = lambda i: F.expr(f"substring(text, {i}, 1)").rlike(f"^{ALNUM}$")
    e = e.withColumn("ok", ok).withColumn("cut", F.when(ok, cut)).withColumn("over", ok & (F.col("start") < reach))
    inner_l, inner_r = (edge("start + 1"), edge("end"))
    cuts = (F.col("start") > 0) & edge("start") & inner_l | (F.col("end") < F.length("text")) & edge("end + 1") & inner_r
    counts = {
        "spans": F.lit(True), "out_of_range": ~F.col("ok"), "surface_checked": F.col("ok") & F.col("surface").isNotNull(), "surface_match": F.col("ok") & (F.col("surface") == F.col("cut")),
        "whitespace_edge": F.col("ok") & F.col("cut").rlike(r"(?U)^\s|\s$"), "cuts_word": F.col("ok") & cuts, "overlapping": F.coalesce("over", F.lit(False)),
    }
    row = e.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    return row.unpivot([], list(counts), "issue", "n")


def census_labels(raws: DataFrame, dataset: str, spark: SparkSession) -> DataFrame:
    """(raw, n, canonical): unmapped ones have none."""
    e = exploded(raws).where("label is not null").select(F.lit(dataset).alias("dataset"), F.col("label").alias("raw"))
    return map_labels(e.groupBy("dataset", "raw").agg(F.count("*").alias("n")), spark, strict=False).select("raw", "n", "canonical")


def length_profile(docs: DataFrame) -> DataFrame:
    n = F.length("text")
    return docs.agg(F.count("*").alias("docs"), *[F.percentile(n, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99, 1.0)])
