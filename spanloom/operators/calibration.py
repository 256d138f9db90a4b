"""Calibration of scored spans: greedy candidates, Brier, calibration error, risk against coverage, isotonic fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import prob
from spanloom.operators.order import Falling, running
from spanloom.operators.spans import as_b, merged_gold, overlap_join
from spanloom.schema import IGNORE
from spanloom.session import stash

FLOOR, IOU = 0.05, 0.5


def _greedy(pairs: list[dict]) -> list[dict]:
    ps, gs, won = set(), set(), []
    for x in sorted(pairs, key=lambda r: (-r["score"], -r["iou"], r["p"], r["g"])):
        if x["p"] not in ps and x["g"] not in gs:
            ps.add(x["p"])
            gs.add(x["g"])
            won.append({"p": x["p"], "g": x["g"]})
    return won


def candidates(preds: DataFrame, gold: DataFrame, typed: bool = False, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, start, end, label, score, target) and one row (total_gold, uncovered).

    Predictions from the floor on, matched one to one with merged gold at IoU 0.5 or more: best score first, then best
    IoU, then order. Candidates that overlap IGNORE gold alone are left out. Only documents with a pair reach Python.
    """
    mg = merged_gold(gold).withColumn("g", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")))
    pr = preds.where(F.col("score") >= floor).withColumn("p", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "label", F.col("score").desc())))
    j = overlap_join(pr.select("doc_id", "start", "end", "label", "score", "p"), as_b(mg, b_label="label", g="g"))
    if typed:
        j = j.where("label = b_label")
    j = j.withColumn("iou", prob.iou(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))).where(F.col("iou") >= IOU)

    @F.pandas_udf("array<struct<p: int, g: int>>")
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([_greedy(list(x)) for x in b])

    won = j.groupBy("doc_id").agg(F.collect_list(F.struct("p", "g", "score", "iou")).alias("r")).select("doc_id", F.explode(pick("r")).alias("x")).select("doc_id", "x.*")
    free = overlap_join(overlap_join(pr, as_b(mg), how="left_anti"), as_b(gold.where(F.col("label") == IGNORE)), how="left_semi").select("doc_id", "p")
    out = pr.join(free, ["doc_id", "p"], "left_anti").join(won.select("doc_id", "p", F.lit(1).alias("target")), ["doc_id", "p"], "left")
    cover = mg.join(won.select("doc_id", "g", F.lit(1).alias("hit")), ["doc_id", "g"], "left").agg(F.count("*").alias("total_gold"), F.count_if(F.col("hit").isNull()).alias("uncovered"))
    return out.select("doc_id", "start", "end", "label", "score", F.coalesce("target", F.lit(0)).alias("target")), cover


def brier(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.pow(F.col("score") - F.col("target"), 2)), F.lit(float("nan"))).alias("brier"))


def adaptive_ece(rows: DataFrame, key: str, bins: int = 15) -> DataFrame:
    """Equal-count bins in order of score, then key; the first ones hold one more where counts don't divide. NaN without rows."""
    n = rows.count()
    b = max(1, min(bins, n))
    base, extra = divmod(n, b)
    wide = extra * (base + 1)
    r = running(rows.select("score", "target", key), [F.col("score"), F.col(key)])
    bin_ = F.when(F.col("rank") < wide, F.expr(f"rank div {base + 1}")).otherwise(F.expr(f"{extra} + (rank - {wide}) div {max(base, 1)}"))
    g = r.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k"), F.avg("score").alias("p"), F.avg("target").alias("y"))
    return g.agg(F.coalesce(F.sum(F.col("k") / max(n, 1) * F.abs(F.col("p") - F.col("y"))), F.lit(float("nan"))).alias("ece"))


def width_ece(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Equal-width bins, the last closed on the right."""
    g = rows.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("k"), F.avg("score").alias("p"), F.avg("target").alias("y"))
    return g.agg((F.sum(F.col("k") * F.abs(F.col("p") - F.col("y"))) / F.sum("k")).alias("ece"))


def quantile_ece(rows: DataFrame, bins: int = 15) -> DataFrame:
    """Bins between quantiles of the score."""
    edges = rows.agg(F.percentile("score", F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0] or []
    bin_ = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col("score")))
    g = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k"), F.avg("score").alias("p"), F.avg("target").alias("y"))
    return g.agg((F.sum(F.col("k") * F.abs(F.col("p") - F.col("y"))) / F.sum("k")).alias("ece"))


def brier_skill(rows: DataFrame, calib: DataFrame) -> DataFrame:
    """1 - Brier / Brier of the calibration base rate; null if that is 0 or there are no rows."""
    rate = calib.agg(F.avg("target")).first()[0]
    b = rows.agg(F.avg(F.pow(F.col("score") - F.col("target"), 2)).alias("b"), F.avg(F.pow(F.lit(rate) - F.col("target"), 2)).alias("b0"))
    return b.select(F.when(F.col("b0") > 0, 1 - F.col("b") / F.col("b0")).alias("skill"))


def risk_coverage(rows: DataFrame, key: str) -> DataFrame:
    """(i, coverage, risk): errors among the i most confident rows, by score and then key."""
    n = rows.count()
    r = running(rows.select("score", "target", key), [Falling(F.col("score")), F.col(key)], {"before": 1 - F.col("target")})
    i = F.col("rank") + 1
    return r.select(i.alias("i"), (i / n).alias("coverage"), ((F.col("before") + 1 - F.col("target")) / i).alias("risk"))


def auroc(rows: DataFrame) -> DataFrame:
    """Share of positive-negative pairs in the right order, ties half; counts by score are added up in order."""
    s = rows.groupBy("score").agg(F.sum("target").alias("pos"), F.sum(1 - F.col("target")).alias("neg"))
    won = running(s, [F.col("score")], {"below": F.col("neg")}).select((F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("w"), "pos", "neg")
    return won.agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("w") / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auroc"))


def lower_quantile(rows: DataFrame, coverage: float) -> float | None:
    """The value at index floor((n - 1) * (1 - coverage)) in order of score; none without rows."""
    n = rows.count()
    k = math.floor((n - 1) * (1 - coverage))
    s = running(rows.groupBy("score").agg(F.count("*").alias("k")), [F.col("score")], {"before": F.col("k")})
    return s.where((F.col("before") <= k) & (F.col("before") + F.col("k") > k)).agg(F.min("score")).first()[0]


# Isotonic recalibration ----------------------------------------------------------------------------------------------

#: Cells of the score in which rows meet the pieces of a fit.
CELLS = 1024
_BLOCK = "label string, lo double, hi double, k double, s double"


def pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Adjacent blocks (lo, hi, k rows, sum s) in order of lo, pooled until their means rise.

    Pooling what violates the order in any sequence gives the same blocks, so parts may be pooled apart and then together.
    """
    out: list[list[float]] = []
    for lo, hi, k, s in blocks.sort_values("lo")[["lo", "hi", "k", "s"]].itertuples(index=False):
        out.append([lo, hi, k, s])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, k, s = out.pop()
            out[-1][1:] = [hi, out[-1][2] + k, out[-1][3] + s]
    return pd.DataFrame(out, columns=["lo", "hi", "k", "s"])


def isotonic_blocks(rows: DataFrame, least: int = 50) -> DataFrame:
    """(label, lo, hi, k, s): the rising fit of target by score of each label with at least `least` rows; null label: of all.

    Rows are counted by (label, score) first. Blocks are pooled inside ranges of the order (label, score), then once more by
    label, where only what is left of each range comes together: with targets of 0 and 1 the means of n rows' blocks are
    rising fractions, so there are some n^(2/3) at most. All labels are fitted in one job.
    """
    own = F.explode(F.array(F.col("label"), F.lit(None).cast("string")))
    seen = rows.select("score", "target", F.col("label").cast("string").alias("label"))
    seen = seen.where("label is not null").select("score", "target", own.alias("label")).unionByName(seen.where("label is null"))
    points = seen.groupBy("label", "score").agg(F.count("*").cast("double").alias("k"), F.sum("target").cast("double").alias("s"))
    enough = points.groupBy("label").agg(F.sum("k").alias("n")).where((F.col("n") >= least) | F.col("label").isNull())
    points = points.join(enough.select(F.col("label").alias("_l")), F.col("label").eqNullSafe(F.col("_l")), "left_semi")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = points.repartitionByRange(parts, "label", "score").withColumn("part", F.spark_partition_id())

    def of_group(t: pd.DataFrame) -> pd.DataFrame:
        return pool(t).assign(label=t["label"].iloc[0])[["label", "lo", "hi", "k", "s"]]

    def of_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:  # a batch is a run of the order, as its partition is sorted
            for _, x in t.groupby("label", dropna=False):
                yield of_group(x)

    local = ranged.select("label", F.col("score").alias("lo"), F.col("score").alias("hi"), "k", "s").sortWithinPartitions("label", "lo")
    return local.mapInPandas(of_range, _BLOCK).groupBy("label").applyInPandas(of_group, _BLOCK)


def isotonic(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (score, label, ...) with fitted: the label's fit, or that of all where the label has none.

    Between blocks the fit is a straight line, beyond the ends it is level. Rows meet the pieces of a fit by label and cell
    of the score, so no fit is held whole by a task.
    """
    ends = F.explode(F.array(F.col("lo"), F.col("hi")))
    p = blocks.select("label", ends.alias("x"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s") / F.col("k"))).alias("y")).distinct()
    w = Window.partitionBy("label").orderBy("x")
    p = p.select(F.coalesce("label", F.lit("")).alias("_fit"), F.col("label").isNull().alias("_all"), "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).withColumns({"x1": F.coalesce("x1", "x"), "y1": F.coalesce("y1", "y")})
    span = p.groupBy("_fit", "_all").agg(F.min("x").alias("_min"), F.max("x").alias("_max"))
    cell = lambda c: F.floor(c * CELLS).cast("long")
    pieces = p.withColumn("_last", F.col("x") == F.col("x1")).withColumn("_cell", F.explode(F.sequence(cell(F.col("x")), cell(F.col("x1")))))
    own = span.where("not _all").select(F.col("_fit").alias("_own"))
    r = rows.join(own, F.col("label").cast("string") == F.col("_own"), "left")
    r = r.withColumns({"_fit": F.coalesce("_own", F.lit("")), "_all": F.col("_own").isNull()}).drop("_own").join(span, ["_fit", "_all"])
    r = r.withColumn("_at", F.least(F.greatest("score", "_min"), "_max")).withColumn("_cell", cell(F.col("_at")))
    inside = (F.col("_at") >= F.col("x")) & ((F.col("_at") < F.col("x1")) | F.col("_last"))
    r = r.join(pieces, ["_fit", "_all", "_cell"]).where(inside)
    share = F.when(F.col("_last"), 0.0).otherwise((F.col("_at") - F.col("x")) / (F.col("x1") - F.col("x")))
    return r.withColumn("fitted", F.col("y") + share * (F.col("y1") - F.col("y"))).select(*rows.columns, "fitted")


# Temperatures --------------------------------------------------------------------------------------------------------

#: Bounds of a temperature, and of the passes over the rows.
COLDEST, HOTTEST, PASSES = 0.05, 20.0, 60


def fit_temperatures(rows: DataFrame, kinds: tuple[str, ...]) -> dict[str, float]:
    """The temperature of least cross-entropy for each kind, from rows (kind, logits array, target index); 1 without rows.

    The loss is convex in 1 / T, so all kinds take one safeguarded Newton step a pass, from sums of gradient and curvature by
    kind: a handful of passes for any number of kinds. What lies beyond the bounds is cut off there. Rows without a target
    among their logits are left out.
    """
    spark = rows.sparkSession
    z = F.col("logits")
    top = F.array_max(z)
    kept = rows.where(F.col("kind").isin(list(kinds)) & F.get(z, F.col("target")).isNotNull())
    kept = stash(kept.select("kind", F.transform(z, lambda x: x - top).alias("z"), (F.get(z, F.col("target")) - top).alias("right")), "logits")
    todo = {r.kind: Search() for r in kept.select("kind").distinct().collect()}  # kinds are few
    done = dict.fromkeys(kinds, 1.0)
    for _ in range(PASSES):
        if not todo:
            break
        b = spark.createDataFrame([(k, todo[k].beta) for k in sorted(todo)], "kind string, beta double")
        e = kept.join(F.broadcast(b), "kind").withColumn("e", F.transform("z", lambda x: F.exp(x * F.col("beta"))))
        total = prob.total(F.col("e"))
        first, second = prob.total(F.zip_with("z", "e", lambda x, y: x * y)), prob.total(F.zip_with("z", "e", lambda x, y: x * x * y))
        m = e.select("kind", (first / total).alias("m"), (second / total).alias("q"), "right")
        for r in m.groupBy("kind").agg(F.sum(F.col("m") - F.col("right")).alias("g"), F.sum(F.col("q") - F.col("m") * F.col("m")).alias("h")).collect():
            done[r.kind] = 1 / todo[r.kind].beta
            if todo[r.kind].settled(r.g, r.h):
                del todo[r.kind]
    return done


class Search:
    """Least point of a convex function of beta = 1 / T from gradients g and curvatures h: both bounds, then Newton's steps.

    A step that leaves the bracket, or isn't half as long as the one before, halves the bracket instead.
    """

    def __init__(self) -> None:
        self.lo, self.hi, self.beta, self.last, self.open = 1 / HOTTEST, 1 / COLDEST, 1 / HOTTEST, math.inf, 2

    def settled(self, g: float, h: float) -> bool:
        """Takes the gradient at beta and moves on; true if beta is the place."""
        if self.open:
            self.open -= 1
            if self.open:  # at the lower bound
                self.flat = g == 0
                self.beta = self.hi if g <= 0 else self.lo
                return g > 0
            self.beta = 1.0 if self.flat and g == 0 else self.hi if g <= 0 else 1.0
            return g < 0
        if g == 0:
            return True
        self.lo, self.hi = (self.lo, self.beta) if g > 0 else (self.beta, self.hi)
        new = self.beta - g / h if h > 0 else math.inf
        if not self.lo < new < self.hi or abs(math.log(new / self.beta)) > self.last / 2:
            new = (self.lo * self.hi) ** 0.5
        self.last, self.beta = abs(math.log(new / self.beta)), new
        return self.last <= 1e-12


def fit_temperature(rows: DataFrame, steps: int = 80) -> float:
    """Temperature of logit(score) with the least log loss: golden section over log T in -3..3, a pass each step.

    Rows are reduced to counts per (score, target) once.
    """
    s = stash(rows.groupBy("score", "target").agg(F.count("*").alias("k")), "temperature")
    p0 = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col("score")))
    s = s.withColumn("z", F.log(p0 / (1 - p0)))

    def loss(log_t: float) -> float:
        p = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), 1 / (1 + F.exp(-F.col("z") / math.exp(log_t)))))
        return s.agg(-F.sum(F.col("k") * (F.col("target") * F.log(p) + (1 - F.col("target")) * F.log(1 - p))) / F.sum("k")).first()[0]

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    lc, ld = loss(c), loss(d)
    for _ in range(steps):
        if b - a < 1e-4:
            break
        if lc < ld:
            b, d, ld = d, c, lc
            c = b - g * (b - a)
            lc = loss(c)
        else:
            a, c, lc = c, d, ld
            d = a + g * (b - a)
            ld = loss(d)
    return math.exp((a + b) / 2)
