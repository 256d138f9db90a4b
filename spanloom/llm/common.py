"""What the corpus operators share: word arrays, bindings inside expressions, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import stash

#: Whitespace of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
#: Rows and bytes of an Arrow batch: a batch of texts is closed by its bytes, one of numbers by its rows.
ARROW_ROWS, ARROW_BYTES = 10_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case: name with as many underscores before it as it takes."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)  # noqa: PLW0108  a lambda of one argument


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shingle_hashes(w: Column, n: int) -> Column:
    """XXH64 of the n-word shingles of a word array bound by let(); the whole sequence if shorter, none if empty."""
    def nth(i: Column) -> Column:
        return F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))

    return (
        F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < n, F.array(F.xxhash64(F.concat_ws(" ", w))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), nth))
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), component the smallest id reached.

    Alternating large-star and small-star contraction. Minima are pre-aggregated before each shuffle and joined back,
    so a hub's edges stay spread. Only ids that have an edge to another id are returned. No edges: no rows.
    """
    e = stash(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
