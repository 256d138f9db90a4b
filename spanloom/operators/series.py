"""Ordered series of runs: rolling medians, departures, batch flags, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_median(rows: DataFrame, by: str, order: list[str], value: str, width: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))


def departures(rows: DataFrame, by: str, order: str, value: str, base: str, ratio: float, margin: float, streak: int) -> DataFrame:
    """(by, first): the first step of `streak` steps in a row on which value exceeds base by ratio and by margin."""
    w = Window.partitionBy(by).orderBy(order)
    r = rows.withColumn("_hit", ((F.col(value) > F.col(base) * ratio) & (F.col(value) - F.col(base) > margin)).cast("int"))
    r = r.withColumn("_run", F.sum(1 - F.col("_hit")).over(w)).where("_hit = 1")
    g = r.groupBy(by, "_run").agg(F.count("*").alias("n"), F.min(order).alias("first")).where(F.col("n") >= streak)
    return g.groupBy(by).agg(F.min("first").alias("first"))


def high_batches(rows: DataFrame, order: list[str], value: str, width: int, factor: float, by: str) -> DataFrame:
    """rows with p95 over the last width rows and high: value above factor times it a row before."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(width - 1), 0)
    r = rows.withColumn("p95", F.percentile(value, F.lit(0.95)).over(w))
    return r.withColumn("high", F.coalesce(F.col(value) > factor * F.lag("p95").over(Window.partitionBy(by).orderBy(*order)), F.lit(False)))


def nearest_rank(rows: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """The value at rank ceil(q * n)."""
    n = F.count("*")
    counts = rows.groupBy(*by, value).agg(n.alias("k"))
    w = Window.partitionBy(*by)
    c = counts.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    return c.where(F.col("upto") >= F.ceil(F.col("n") * q)).groupBy(*by).agg(F.min(value).alias("value"))


def totals(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def census(rows: DataFrame, labels: DataFrame, column: str, fail: int, fall_back: int) -> DataFrame:
    """(label, n, status) for a fixed list of labels, those without rows too."""
    c = rows.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    d = labels.select("label").join(c, "label", "left").na.fill(0, ["n"])
    return d.withColumn("status", F.when(F.col("n") < fail, "fail").when(F.col("n") < fall_back, "fallback").otherwise("ok"))


def merged_counts(reports: DataFrame) -> DataFrame:
    """reports (docs long, counts map<string, long>): one row of sums, key by key."""
    flat = reports.select(F.explode_outer("counts").alias("k", "v")).where("k is not null").groupBy("k").agg(F.sum("v").alias("v"))
    m = flat.agg(F.lit(1).alias("_one"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("counts"))
    return reports.agg(F.lit(1).alias("_one"), F.sum("docs").alias("docs")).join(m, "_one").drop("_one")  # one row each
