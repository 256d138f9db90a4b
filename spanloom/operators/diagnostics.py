"""Reports on scored spans and answers: recalls, error kinds, typing of held-out labels, prior correction, scoreboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import prob
from spanloom.operators.spans import as_b, overlap_join
from spanloom.operators.splits import top_k
from spanloom.operators.vectors import nearest

KEYS = ["doc_id", "start", "end"]


def boundary_recall(preds: DataFrame, gold: DataFrame, least: float) -> DataFrame:
    """One row (n, found, recall): gold spans with a prediction of the same offsets that scores least or more."""
    hit = preds.where(F.col("score") >= least).select(*KEYS, F.lit(1).alias("_hit")).distinct()
    g = gold.join(hit, KEYS, "left").agg(F.count("*").alias("n"), F.count("_hit").alias("found"))
    return g.withColumn("recall", prob.ratio(F.col("found"), F.col("n")))


def typing_by_label(preds: DataFrame, gold: DataFrame, least_n: int = 1) -> DataFrame:
    """(label, n, matched, right, accuracy): of gold spans with a prediction at their offsets, those whose best one has the label."""
    best = preds.groupBy(*KEYS).agg(F.max_by("label", F.struct("score", "label")).alias("_said"))
    g = gold.join(best, KEYS, "left").groupBy("label").agg(F.count("*").alias("n"), F.count("_said").alias("matched"), F.count_if(F.col("_said") == F.col("label")).alias("right"))
    return g.where(F.col("n") >= least_n).withColumn("accuracy", prob.ratio(F.col("right"), F.col("matched")))


def macro(by_label: DataFrame, value: str = "accuracy") -> DataFrame:
    """One row (labels, macro): mean over labels that have a value."""
    v = F.when(~F.isnan(value), F.col(value))
    return by_label.agg(F.count(v).alias("labels"), F.avg(v).alias("macro"))


def candidate_gate(candidates: DataFrame, gold: DataFrame, k: int, least: float) -> DataFrame:
    """One row (n, found, recall, passed): gold spans among the k best candidates of their document."""
    few = top_k(candidates, k, ["doc_id"], [F.col("score").desc(), F.col("start"), F.col("end")])
    r = boundary_recall(few, gold, float("-inf"))
    return r.withColumn("passed", F.coalesce(F.col("recall") >= least, F.lit(False)))


def covered_chars(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (chars, covered, recall): gold characters that any prediction covers. Spans of one side may overlap."""
    j = overlap_join(gold.select(*KEYS), as_b(preds)).select("doc_id", "start", "end", F.greatest("start", "b_start").alias("s"), F.least("end", "b_end").alias("e"))
    order = Window.partitionBy(*KEYS).orderBy("s", "e")
    reach = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("start"))
    part = j.withColumn("_n", F.greatest(F.lit(0), F.col("e") - F.greatest("s", reach)))
    c = part.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("covered"), F.lit(1).alias("_one"))
    n = gold.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("chars"), F.lit(1).alias("_one"))
    return n.join(c, "_one").select("chars", "covered", prob.ratio(F.col("covered"), F.col("chars")).alias("recall"))  # one row each


def length_class(n: Column) -> Column:
    return F.when(n <= 6, "short").when(n <= 10, "middle").otherwise("long")


def errors(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, kind, said, size): gold spans that are matched exactly, only overlapped, or absent."""
    best = preds.groupBy(*KEYS).agg(F.max_by("label", F.struct("score", "label")).alias("said"))
    near = overlap_join(gold.select(*KEYS), as_b(preds), how="left_semi").distinct().withColumn("_near", F.lit(True))
    g = gold.join(best, KEYS, "left").join(near, KEYS, "left")
    kind = F.when(F.col("said").isNotNull(), "matched").when(F.col("_near"), "overlap").otherwise("absent")
    return g.select(*KEYS, "label", kind.alias("kind"), "said", length_class(F.col("end") - F.col("start")).alias("size"))


def error_summary(found: DataFrame) -> DataFrame:
    """(size, kind, n, right): counts of errors() by length class and kind; right: matched ones with the label."""
    return found.groupBy("size", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("label")).alias("right"))


def confusions(found: DataFrame, k: int = 12) -> DataFrame:
    """(label, said, n, rank): the commonest wrong labels of matched spans."""
    c = found.where(F.col("said") != F.col("label")).groupBy("label", "said").agg(F.count("*").alias("n"))
    first = c.orderBy(F.col("n").desc(), "label", "said").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "label", "said")))  # k rows


def answer_summary(rows: DataFrame, none: int) -> DataFrame:
    """One row (n, gold_accuracy, none_accuracy, none_rate, mean_top): rows (target, probabilities); none: its option's index."""
    pick = prob.argmax(F.col("probabilities"))
    ok = (pick == F.col("target")).cast("double")
    return rows.agg(F.count("*").alias("n"), F.avg(F.when(F.col("target") != none, ok)).alias("gold_accuracy"), F.avg(F.when(F.col("target") == none, ok)).alias("none_accuracy"), F.avg((pick == none).cast("double")).alias("none_rate"), F.avg(F.array_max("probabilities")).alias("mean_top"))


def top_picks(rows: DataFrame, k: int = 5) -> DataFrame:
    """(pick, n, rank): the options that are chosen most often."""
    c = rows.groupBy(prob.argmax(F.col("probabilities")).alias("pick")).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "pick"))).where(F.col("rank") <= k)  # a row an option


def prior_correction(rows: DataFrame, fold: Column, none: int, grid: list[float]) -> DataFrame:
    """(test_fold, offset, before, after): an offset of none's log probability, fitted on one half and tested on the other.

    Each half is counted once for all offsets; the best has most right answers, of equals the smallest in size, then the
    lower. fold gives 0 or 1.
    """
    d = rows.select(fold.cast("int").alias("fold"), "target", "probabilities").withColumn("offset", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    moved = F.transform("probabilities", lambda p, i: F.log(F.greatest(p, F.lit(1e-30))) + F.when(i == none, F.col("offset")).otherwise(0.0))
    c = d.groupBy("fold", "offset").agg(F.avg((prob.argmax(moved) == F.col("target")).cast("double")).alias("accuracy"))
    best = c.groupBy("fold").agg(F.max_by("offset", F.struct("accuracy", (-F.abs("offset")).alias("a"), (-F.col("offset")).alias("b"))).alias("offset"))
    test = best.select((1 - F.col("fold")).alias("fold"), "offset")
    after = c.withColumnRenamed("accuracy", "after").join(test, ["fold", "offset"])
    before = c.where("offset = 0").select("fold", F.col("accuracy").alias("before"))
    return after.join(before, "fold").select(F.col("fold").alias("test_fold"), "offset", "before", "after")


def neighbour_audit(held: DataFrame, trained: DataFrame) -> DataFrame:
    """(label, same_node, remaining, nearest, cosine): for each held-out label the trained ones of its node, which must not
    stay, how many others there are, and which of these is nearest. Both: (label, node, unit); one row a label."""
    same = held.select("label", "node").join(trained.select("node", F.lit(1).alias("_same")), "node", "left").groupBy("label", "node").agg(F.count("_same").alias("same_node"))
    n = trained.count()
    q = held.select(F.col("label").alias("query_id"), "unit")
    k = nearest(q, trained.select(F.col("label").alias("id"), "unit"), n).join(held.select(F.col("label").alias("query_id"), F.col("node").alias("_own")), "query_id")
    k = k.join(trained.select(F.col("label").alias("id"), "node"), "id").where("node <> _own")
    first = k.groupBy("query_id").agg(F.max_by(F.struct("id", "cosine"), F.struct("cosine", "id")).alias("x"))
    return same.join(first.withColumnRenamed("query_id", "label"), "label", "left").select("label", "same_node", (F.lit(n) - F.col("same_node")).alias("remaining"), F.col("x.id").alias("nearest"), F.col("x.cosine").alias("cosine"))


def scoreboard(scores: dict[str, DataFrame], by: str, ascending: bool = True) -> DataFrame:
    """Score tables of many systems, each with the same columns, as one with place: the rank in its dataset."""
    every = reduce(DataFrame.unionByName, [d.withColumn("system", F.lit(s)) for s, d in scores.items()])
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return every.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(order, "system")))


def char_ece(hist: DataFrame, bins: int = 15) -> DataFrame:
    """Calibration error over characters, from counts (score, n_pii, n_non): bins between quantiles of the score.

    A score on an edge belongs to the bin above it; counts stand for their characters, so quantiles are those of all.
    """
    h = hist.groupBy("score").agg(F.sum("n_pii").alias("pii"), F.sum(F.col("n_pii") + F.col("n_non")).alias("n")).where("n > 0")
    at = ", ".join(repr(i / bins) for i in range(1, bins))
    edges = h.agg(F.expr(f"percentile(score, array({at}), n)")).first()[0] or []
    bin_ = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col("score")))
    g = h.groupBy(bin_.alias("bin")).agg(F.sum("n").alias("k"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("p"), (F.sum("pii") / F.sum("n")).alias("y"))
    return g.agg((F.sum(F.col("k") * F.abs(F.col("p") - F.col("y"))) / F.sum("k")).alias("ece"))
