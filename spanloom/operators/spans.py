"""Span algebra: interval joins, merging, deduplication, stitching, suppression, matching."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import prob
from spanloom.schema import IGNORE, is_pii

#: Characters of a cell: spans of one document meet cell by cell, so a very long document is spread over tasks.
CELL = 1024


def overlap_join(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("doc_id",), how: str = "inner", cell: int = CELL) -> DataFrame:
    """Rows of a and b with the same keys that share a character; b has b_start and b_end.

    Both sides are dealt by (keys, cell); a pair that meets in several cells is kept in the first. how: inner, left_semi
    or left_anti (of a).
    """
    def cells(d: DataFrame, s: str, e: str, name: str) -> DataFrame:
        return d.withColumn(name, F.explode(F.sequence(F.expr(f"`{s}` div {cell}"), F.greatest(F.expr(f"`{s}` div {cell}"), F.expr(f"(`{e}` - 1) div {cell}")))))

    inside = (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start"))
    if how == "inner":
        j = cells(a, "start", "end", "_cell").join(cells(b, "b_start", "b_end", "_cell"), [*keys, "_cell"])
        return j.where(inside & (F.col("_cell") == F.greatest(F.expr(f"start div {cell}"), F.expr(f"b_start div {cell}")))).drop("_cell")
    ids = a.select(*keys, "start", "end").distinct()
    hit = cells(ids, "start", "end", "_cell").join(cells(b.select(*keys, "b_start", "b_end"), "b_start", "b_end", "_cell"), [*keys, "_cell"]).where(inside).select(*keys, "start", "end").distinct()
    return a.join(hit, [*keys, "start", "end"], how)


def as_b(d: DataFrame, **named: str) -> DataFrame:
    """doc_id, b_start, b_end and columns under new names, for the right side of a join."""
    return d.select("doc_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"), *[F.col(v).alias(k) for k, v in named.items()])


def dedupe(spans: DataFrame) -> DataFrame:
    """The first by pos of equal (doc_id, start, end, label); overlapping ones stay."""
    w = Window.partitionBy("doc_id", "start", "end", "label").orderBy("pos")
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged_gold(gold: DataFrame) -> DataFrame:
    """(doc_id, start, end, label): unions of overlapping PII mentions, with the label of the first by start, longest first.

    Mentions that only touch stay apart.
    """
    g = gold.where(is_pii(F.col("label")))
    order = Window.partitionBy("doc_id").orderBy("start", F.col("end").desc(), "label")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("_new", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("_island", F.sum("_new").over(order))
    first = F.min_by("label", F.struct("start", (-F.col("end")).alias("e"), "label"))
    return g.groupBy("doc_id", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("label")).drop("_island")


def stitch(detections: DataFrame) -> DataFrame:
    """Detections of overlapping windows (doc_id, start, end, label, score, win, pos), one for each span: the best score,
    of equals the first."""
    w = Window.partitionBy("doc_id", "start", "end", "label").orderBy(F.col("score").desc(), "win", "pos")
    return detections.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_cut(detections: DataFrame) -> DataFrame:
    """Without detections that touch an inner edge of their window (win_start, win_end, doc_length)."""
    left = (F.col("start") == F.col("win_start")) & (F.col("win_start") > 0)
    right = (F.col("end") == F.col("win_end")) & (F.col("win_end") < F.col("doc_length"))
    return detections.where(~(left | right))


def admit(detections: DataFrame, known: DataFrame, floor: float) -> DataFrame:
    """detections (label, start, end, length, score) with status: unknown_label, bad_bounds, below_floor or ok."""
    d = detections.join(known.select("label", F.lit(True).alias("_known")), "label", "left")
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.col("length"))
    return d.withColumn("status", F.when(F.col("_known").isNull(), "unknown_label").when(bad, "bad_bounds").when(F.col("score") < floor, "below_floor").otherwise("ok")).drop("_known")


def _suppress(rows: list[dict]) -> list[dict]:
    kept: list[dict] = []
    for x in sorted(rows, key=lambda r: (-r["score"], r["start"], r["end"], r["label"])):
        if all(x["end"] <= k["start"] or x["start"] >= k["end"] for k in kept):
            kept.append(x)
    return kept


def suppress(preds: DataFrame) -> DataFrame:
    """Greedy non-maximum suppression in each document: best score first, what overlaps a kept span goes.

    Order-dependent, hence Python over arrays in Arrow batches; only groups of overlapping spans are handed over.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    p = preds.select("doc_id", "start", "end", "label", "score").withColumn("_new", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    p = p.withColumn("_island", F.sum("_new").over(order))
    row = F.struct("start", "end", "label", "score")
    g = p.groupBy("doc_id", "_island").agg(F.collect_list(row).alias("s"))

    @F.pandas_udf(g.schema["s"].dataType)
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([_suppress(list(x)) for x in b])

    alone, many = g.where(F.size("s") == 1), g.where(F.size("s") > 1).withColumn("s", pick("s"))
    return alone.unionByName(many).select("doc_id", F.explode("s").alias("x")).select("doc_id", "x.*")


def kept_overlaps(spans: DataFrame) -> DataFrame:
    """(doc_id, overlapping): spans that begin before the furthest end so far."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "label").rowsBetween(Window.unboundedPreceding, -1)
    s = spans.withColumn("_over", (F.col("start") < F.max("end").over(order)).cast("int"))
    return s.groupBy("doc_id").agg(F.coalesce(F.sum("_over"), F.lit(0)).cast("long").alias("overlapping"))


def _convex(runs: list[dict]) -> int:
    """Largest one-to-one matching of predictions with the runs lo..hi of the gold spans each overlaps."""
    waiting: list[int] = []
    rows, i, n = sorted((r["lo"], r["hi"]) for r in runs), 0, 0
    if not rows:
        return 0
    g = rows[0][0]
    while i < len(rows) or waiting:
        if not waiting:
            g = max(g, rows[i][0])
        while i < len(rows) and rows[i][0] <= g:
            heapq.heappush(waiting, rows[i][1])
            i += 1
        while waiting and waiting[0] < g:
            heapq.heappop(waiting)
        if waiting:
            heapq.heappop(waiting)
            n += 1
            g += 1
    return n


def matched_counts(preds: DataFrame, gold: DataFrame, typed: bool, mode: str) -> DataFrame:
    """(doc_id, tp, fp, fn) against merged gold: exact offsets (strict) or any shared character (partial), one to one.

    A prediction that overlaps IGNORE gold alone is neither. In partial mode the gold spans a prediction overlaps follow
    one another, so the largest matching takes, gold by gold, the waiting prediction whose last one comes first.
    gold: all labels; preds: (doc_id, start, end, label), those at or above the threshold.
    """
    mg = merged_gold(gold)
    preds = preds.withColumn("_p", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "label")))
    same = F.col("label") == F.col("b_label") if typed else F.lit(True)
    if mode == "strict":
        keys = ["doc_id", "start", "end", *(["label"] if typed else [])]
        tp = mg.join(preds.select(*keys).distinct(), keys, "left_semi").groupBy("doc_id").agg(F.count("*").alias("tp"))
    else:
        kinds = Window.partitionBy("doc_id", *(["label"] if typed else [])).orderBy("start")
        g = as_b(mg.withColumn("_g", F.row_number().over(kinds)), b_label="label", _g="_g")
        pairs = overlap_join(preds.select("doc_id", "start", "end", "label", "_p"), g).where(same)
        span = pairs.groupBy("doc_id", *(["label"] if typed else []), "_p").agg(F.min("_g").alias("lo"), F.max("_g").alias("hi"))
        group = ["doc_id", *(["label"] if typed else [])]

        @F.pandas_udf("long")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series([_convex(list(x)) for x in b])

        tp = span.groupBy(*group).agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select("doc_id", count("r").alias("tp")).groupBy("doc_id").agg(F.sum("tp").alias("tp"))
    ign = as_b(gold.where(F.col("label") == IGNORE))
    bare = overlap_join(preds, as_b(mg), how="left_anti")
    free = overlap_join(bare, ign, how="left_semi").groupBy("doc_id").agg(F.count("*").alias("free"))
    n = preds.groupBy("doc_id").agg(F.count("*").alias("n_pred")).join(mg.groupBy("doc_id").agg(F.count("*").alias("n_gold")), "doc_id", "full")
    out = n.join(tp, "doc_id", "left").join(free, "doc_id", "left").na.fill(0)
    return out.select("doc_id", "tp", (F.col("n_pred") - F.col("tp") - F.col("free")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))


def prf(counts: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 of summed tp, fp, fn."""
    c = counts.groupBy(*by).agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumn("precision", prob.ratio(tp, tp + fp)).withColumn("recall", prob.ratio(tp, tp + fn))
    return c.withColumn("f1", prob.f1(F.col("precision"), F.col("recall")))


def typed_counts(preds: DataFrame, gold: DataFrame, *by: str) -> DataFrame:
    """(by, label, tp, fp, fn) of exact spans as sets; give suppressed predictions. by: columns of a span, such as doc_id."""
    keys = ["doc_id", "start", "end", "label"]
    both = preds.select(*keys).distinct().withColumn("_p", F.lit(1)).join(gold.select(*keys).distinct().withColumn("_g", F.lit(1)), keys, "full")
    hit = F.col("_p").isNotNull() & F.col("_g").isNotNull()
    return both.groupBy(*by, "label").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))


def gold_typing(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (n, matched, right): gold spans, those with a prediction at the same offsets, those whose best one has the label."""
    best = preds.groupBy("doc_id", "start", "end").agg(F.max_by("label", F.struct("score", "label")).alias("said"))
    j = gold.join(best, ["doc_id", "start", "end"], "left")
    return j.agg(F.count("*").alias("n"), F.count("said").alias("matched"), F.count_if(F.col("said") == F.col("label")).alias("right"))


def best_overlap(spans: DataFrame, others: DataFrame) -> DataFrame:
    """spans with the label of the other span that shares most characters, of equals the better scored."""
    j = overlap_join(spans, as_b(others, b_label="label", b_score="score"))
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    return j.groupBy("doc_id", "start", "end").agg(F.max_by("b_label", F.struct(shared.alias("o"), "b_score", "b_label")).alias("label"))


def teacher_zones(teacher: DataFrame, gold: DataFrame, inventory: DataFrame) -> DataFrame:
    """Spans of families (family, nodes array) a source (source, nodes) doesn't annotate in full, clear of its gold."""
    open_ = teacher.join(inventory.select("source", F.col("nodes").alias("_has")), "source").where(F.size(F.array_except("nodes", "_has")) > 0).drop("_has")
    return overlap_join(open_, as_b(gold), how="left_anti")
