"""Sweeps over variants of a system: padded label sets, rewordings. All curves come from one pass over the word runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import prob
from spanloom.functions.text import structs
from spanloom.operators import leak
from spanloom.operators.spans import CELL
from spanloom.schema import IGNORE, is_pii


def padded(rows: DataFrame, logits: str, none: str, sensitive: Sequence[bool], sizes: Sequence[int], keep: Sequence[str] = ("doc_id", "start", "end")) -> DataFrame:
    """(keep, variant, score, drift, says_none): P(sensitive) of each row under label sets of growing size.

    logits (array<double>) has the base labels, as many as sensitive has flags, and then distractors that aren't sensitive,
    in the order in which they are added; none is the logit of no label. A set is the first `size` of them, at least the base
    labels and at most all. drift is the distance to the score under the base labels; says_none: no label is likelier. The
    sums of all sizes are taken from one array of exponentials, with the largest logit taken off. A row with a null logit has
    null scores.
    """
    base = len(sensitive)

    def under(e: Column, size: int) -> Column:
        part = F.slice(e["l"], 1, max(size, base))
        hit = prob.total(F.transform(F.slice(e["l"], 1, base), lambda x, i: F.when(F.get(F.lit([bool(s) for s in sensitive]), i), x).otherwise(0.0)))
        return F.struct(F.lit(str(size)).alias("variant"), (hit / (prob.total(part) + e["n"])).alias("score"), (e["n"] > F.array_max(part)).alias("says_none"))

    top = F.greatest(F.array_max(logits), F.col(none))
    d = rows.withColumn("_e", F.struct(F.transform(logits, lambda x: F.exp(x - top)).alias("l"), F.exp(F.col(none) - top).alias("n")))
    d = d.withColumn("_base", under(F.col("_e"), base)["score"]).select(*keep, "_base", F.explode(F.array(*[under(F.col("_e"), s) for s in sizes])).alias("x"))
    return d.select(*keep, "x.variant", "x.score", F.abs(F.col("x.score") - F.col("_base")).alias("drift"), "x.says_none")


def histograms(runs: DataFrame, preds: DataFrame, variants: Sequence[str], cell: int = CELL) -> DataFrame:
    """(variant, bin, n_pii, n_non) of all variants, and a row (variant, null, ..) of each one's totals.

    runs (doc_id, idx, start, end, n_pii, n_non) and preds (doc_id, start, end, variant, score), each read once: a run meets
    the predictions of all variants in one join, takes its best bin of each, and grouping sets sum bins and totals together,
    on the map side first. A run without prediction is in bin 0 of a variant, so a variant without any has its curve too.
    """
    cells = lambda s, e: F.sequence(F.expr(f"{s} div {cell}"), F.greatest(F.expr(f"{s} div {cell}"), F.expr(f"({e} - 1) div {cell}")))
    r = runs.select("doc_id", "idx", "start", "end", "n_pii", "n_non").withColumn("_cell", F.explode(cells("start", "end")))
    p = preds.select("doc_id", F.col("start").alias("_from"), F.col("end").alias("_to"), "variant", prob.bin_of(F.col("score")).alias("_bin")).withColumn("_cell", F.explode(cells("_from", "_to")))
    p = p.withColumnsRenamed({"doc_id": "_doc", "_cell": "_at"})
    j = r.join(p, (F.col("doc_id") == F.col("_doc")) & (F.col("_cell") == F.col("_at")) & (F.col("start") < F.col("_to")) & (F.col("end") > F.col("_from")), "left")
    best = [F.struct(F.lit(v).alias("variant"), F.coalesce(F.max(F.when(F.col("variant") == v, F.col("_bin"))), F.lit(0)).alias("bin")) for v in variants]
    per = j.groupBy("doc_id", "idx").agg(F.first("n_pii").alias("n_pii"), F.first("n_non").alias("n_non"), F.array(*best).alias("each"))
    per = per.select("n_pii", "n_non", F.inline("each"))
    return per.groupingSets([["variant", "bin"], ["variant"]], "variant", "bin").agg(F.sum("n_pii").alias("n_pii"), F.sum("n_non").alias("n_non"))


@F.arrow_udf(structs("v", "bin", "n_pii", "n_non"))
def _each(runs: pa.Array, preds: pa.Array, gold: pa.Array, variants: pa.Array) -> pa.Array:
    t = leak._Texts(runs, preds, gold)
    p, g = t.spans
    pii = t.under(g, g["ign"] == 0)
    n_pii, hidden = t.chars(pii), t.chars(pii | t.under(g, g["ign"] == 1))
    n_non, n, bins = t.end - t.start - hidden, len(t.offsets) - 1, 1 << 10
    parts = []
    for v in range(variants[0].as_py() if n else 0):
        key, back = np.unique(t.text * bins + t.bins({k: x[p["v"] == v] for k, x in p.items()}), return_inverse=True)
        parts.append([key // bins, np.full(len(key), v), key % bins, *(np.bincount(back, x, len(key)).astype(np.int64) for x in (n_pii, n_non))])
    text, *cols = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 5
    order = np.argsort(text, kind="stable")
    return leak._listed(n, text[order], **dict(zip(("v", "bin", "n_pii", "n_non"), (x[order] for x in cols), strict=True)))


def text_histograms(docs: DataFrame, preds: DataFrame, gold: DataFrame, variants: Sequence[str]) -> DataFrame:
    """histograms() of texts (doc_id, text): a text meets its gold and the predictions of all variants in one row, and what
    leaves it is a row a variant and bin."""
    names = F.array(*[F.lit(v) for v in variants])
    p = preds.where(F.col("variant").isin(*variants)).select("doc_id", "start", "end", (F.array_position(names, F.col("variant")) - 1).cast("int").alias("v"), prob.bin_of(F.col("score")).alias("bin"))
    g = gold.where(is_pii(F.col("label")) | (F.col("label") == IGNORE)).select("doc_id", "start", "end", (F.col("label") == IGNORE).cast("int").alias("ign"))
    d = leak.met(docs, preds=p, gold=g).select(F.inline_outer(_each("runs", "preds", "gold", F.lit(len(variants))))).where("v is not null")
    return d.select(F.get(names, "v").alias("variant"), "bin", "n_pii", "n_non").groupingSets([["variant", "bin"], ["variant"]], "variant", "bin").agg(F.sum("n_pii").alias("n_pii"), F.sum("n_non").alias("n_non"))


def curves(hist: DataFrame) -> DataFrame:
    """(variant, k, leak, over) for k = 0..1001, as leak.curve, from histograms(): at most 1,003 rows a variant.

    Between two bins that hold something the curve stands still, so a row is repeated for the thresholds up to the next.
    """
    whole = F.col("bin").isNull()
    every, order = Window.partitionBy("variant"), Window.partitionBy("variant").orderBy(F.col("at").desc())
    g = hist.withColumn("at", F.coalesce("bin", F.lit(prob.BINS))).withColumns({f"all_{c}": F.max(F.when(whole, F.col(f"n_{c}"))).over(every) for c in ("pii", "non")})
    g = g.withColumns({f"up_{c}": F.sum(F.when(whole, 0).otherwise(F.col(f"n_{c}"))).over(order) for c in ("pii", "non")})
    g = g.where("at > 0").withColumn("low", F.coalesce(F.lead("at").over(order), F.lit(0)))
    g = g.withColumn("k", F.explode(F.sequence(F.col("low"), F.col("at") - 1)))
    nothing = F.col("k") == prob.BINS - 1
    hidden = F.when(nothing, 1.0).when(F.col("all_pii") > 0, 1 - F.col("up_pii") / F.col("all_pii")).otherwise(float("nan"))
    over = F.when(~nothing & (F.col("all_non") > 0), F.col("up_non") / F.col("all_non")).otherwise(0.0)
    return g.select("variant", "k", hidden.alias("leak"), over.alias("over"))


def report(hist: DataFrame, preds: DataFrame) -> DataFrame:
    """(variant, pauc, mean_abs_drift, none_share) from histograms and preds as from padded(). Variants without predictions
    have no drift."""
    area = leak.pauc(curves(hist), "variant")
    moved = preds.groupBy("variant").agg(F.avg("drift").alias("mean_abs_drift"), F.avg(F.col("says_none").cast("double")).alias("none_share"))
    return area.join(moved, "variant", "left")
