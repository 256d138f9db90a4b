"""Benchmark decontamination: size-partitioned MinHash containment search. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ascii_lower, let, words
from spanloom.session import stash

SHINGLE, CONTAINMENT = 5, 0.8
#: Least hashes that a sketch has beyond those an item of its class may lose.
SPARE = 4
#: Rows up to which a sketch or candidate table is broadcast (16 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def shingles(w: Column, n: int) -> Column:
    """Distinct n-word shingles, as text, of a word array bound by let(); none if it is shorter."""
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])))
    )


def hashes(w: Column, n: int) -> Column:
    return F.when(F.size(w) < n, F.array().cast("array<bigint>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))))
    )


def sketches(items: DataFrame, shingle: int, containment: float) -> DataFrame:
    """(item_id, width, grams, n, class, sketch, needed): the least hashes of each item, as many as its size class needs.

    Items are partitioned by size: width 1..shingle-1 for those with fewer words than a shingle (the whole item is one
    shingle), and classes by powers of two of the shingle count above. A document that holds a share of at least
    containment of n shingles lacks at most floor((1 - containment) * n) of them. A class takes as many least hashes as
    its largest item may lose, and SPARE more; a document is a candidate for an item if it holds as many of them as are
    left when all that the item may lose are among them. So each class is probed with a threshold of its own, recall is
    1, and exact verification follows.
    """
    it = items.where("item_id is not null").select(F.col("item_id").cast("long"), words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    it = it.withColumn("width", F.least(F.size("w"), F.lit(shingle)))
    grams = F.array().cast("array<string>")
    for n in range(1, shingle + 1):
        grams = F.when(F.col("width") == n, let(F.col("w"), lambda w, n=n: shingles(w, n))).otherwise(grams)
    it = it.withColumn("grams", grams).withColumn("n", F.size("grams"))
    it = it.withColumn("class", F.ceil(F.log2(F.col("n").cast("double"))).cast("int"))

    def lost(n: Column) -> Column:
        return F.floor(n * (1 - containment) + 1e-9).cast("int")

    k = lost(F.pow(F.lit(2.0), F.col("class"))) + SPARE
    it = it.withColumn("sketch", F.slice(F.array_sort(F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g)))), 1, k))
    return it.withColumn("needed", F.greatest(F.size("sketch") - lost(F.col("n").cast("double")), F.lit(1))).drop("w")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def search(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row struct<doc_id, t>, item_id, n, common) for rows of docs that hold an item; t: Spark's xxhash64 of the text.

    A row's hashes meet the sketches; candidates are verified by shingles as text, one row a candidate and shingle, so a
    document with many items and an item in many documents are spread over tasks.
    """
    it = stash(sketches(items, shingle, containment), "items")
    widths = sorted(r.width for r in it.select("width").distinct().collect())  # shingle values at most
    text, w = F.col("text").cast("string"), F.col("w")
    base = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t")).alias("row"), words(ascii_lower(text)).alias("w"))
    probe = F.concat(F.array().cast("array<bigint>"), *[let(w, lambda v, n=n: hashes(v, n)) for n in widths])
    keys = _few(stash(it.select("item_id", "needed", F.explode("sketch").alias("h")), "sketch"), broadcast_rows)
    met = base.select("row", F.explode(probe).alias("h")).join(keys, "h").select("row", "item_id", "needed", "h").distinct()
    cand = stash(met.groupBy("row", "item_id", "needed").count().where("count >= needed").select("row", "item_id"), "candidates")
    rows = _few(cand.select("row").distinct(), broadcast_rows)
    held = base.join(rows, "row").select("row", F.explode(F.concat(F.array().cast("array<string>"), *[let(w, lambda v, n=n: shingles(v, n)) for n in widths])).alias("gram"))
    grams = stash(it.select("item_id", "n", F.explode("grams").alias("gram")), "item-grams")
    held = held.join(_few(grams.select("gram").distinct(), broadcast_rows), "gram", "left_semi").distinct()
    wanted = cand.join(_few(grams, broadcast_rows), "item_id")
    found = wanted.join(held, ["row", "gram"]).groupBy("row", "item_id", "n").agg(F.count("*").alias("common"))
    return found.where(F.col("common") >= F.col("n") * F.lit(containment) - 1e-9)


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) for every pair at or above the containment.

    Words are runs of characters other than ASCII whitespace, A-Z lower-cased; shingles of a document are those of its
    whole text. Null texts and items without words match nothing; rows without doc_id or item_id are left out; of rows
    with one doc_id the best match counts; items with one item_id are one row of the result each text, the best again.
    Other columns are ignored. Empty tables: no rows.
    """
    found = search(docs, items, shingle, containment, broadcast_rows).where("row.doc_id is not null")
    best = found.groupBy(F.col("row.doc_id").alias("doc_id"), "item_id").agg(F.max(F.col("n")).cast("long").alias("n_shingles"), F.max("common").cast("long").alias("n_common"))
    return best.withColumn("containment", F.col("n_common") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold an item, all columns kept.

    Rows are told apart by doc_id and text: of a doc_id that repeats only the rows that hold an item go. Rows without
    doc_id go by their text alike. Null texts and texts without words stay. Empty tables: docs as they are.
    """
    gone = _few(stash(search(docs, items).select(F.col("row").alias("of_row")).distinct(), "leaks"), BROADCAST_ROWS)
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    return docs.join(gone, row == gone["of_row"], "left_anti")
