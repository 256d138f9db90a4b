"""Ranks and running sums over all rows in one total order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import stash


def running(rows: DataFrame, by: list[Column], sums: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """rows with rank (from 0) in the order of `by`, and for each name of sums the sum of that column over all rows before.

    Rows are dealt by sampled ranges of `by`, so the parts follow one another and are alike in size; a window counts inside
    a part, the totals of the parts before are added: one row a part. by must tell rows apart, or equal rows share a part and
    their ranks are arbitrary. The dealing is stored, as the ranges of another run would be sampled anew. Nulls sum as 0.
    """
    spark = rows.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = list(sums or {})
    d = rows.withColumns({f"_by{i}": _value(c) for i, c in enumerate(by)} | {f"_of{i}": F.coalesce(sums[n], F.lit(0)) for i, n in enumerate(names)})
    order = [F.col(f"_by{i}").desc() if _falls(c) else F.col(f"_by{i}").asc() for i, c in enumerate(by)]
    d = stash(d.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    d = d.withColumns({"rank": F.row_number().over(inside).cast("long") - 1} | {n: F.coalesce(F.sum(f"_of{i}").over(before), zero) for i, n in enumerate(names)})
    # one row a part from here on
    totals = d.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(f"_of{i}").alias(f"_sum{i}") for i in range(len(names))])
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", F.coalesce(F.sum("_rows").over(upto), zero).alias("_rows"), *[F.coalesce(F.sum(f"_sum{i}").over(upto), zero).alias(f"_sum{i}") for i in range(len(names))])
    d = d.join(F.broadcast(base), "_part")
    d = d.withColumns({"rank": F.col("rank") + F.col("_rows")} | {n: F.col(n) + F.col(f"_sum{i}") for i, n in enumerate(names)})
    return d.drop("_part", "_rows", *[f"_by{i}" for i in range(len(by))], *[f"_{x}{i}" for x in ("of", "sum") for i in range(len(names))])


class Falling:
    """A key whose order falls; as Column.desc() can't be taken apart again."""

    def __init__(self, column: Column) -> None:
        self.column = column


def _value(c: Column | Falling) -> Column:
    return c.column if isinstance(c, Falling) else c


def _falls(c: Column | Falling) -> bool:
    return isinstance(c, Falling)
