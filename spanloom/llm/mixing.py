"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import n_words
from spanloom.session import stash

#: Fractional step of the golden-ratio sequence (fixed value: (sqrt(5) - 1) / 2).
GOLDEN = 0.6180339887498949
#: Slots of the schedule at least, and words of a block at most: the schedule grows once blocks reach this size.
SLOTS, BLOCK_WORDS = 65536, 4096
#: Documents of a source that share a piece of its running total.
PIECE_ROWS = 4096
#: Cells of the cumulative weights, by which slots find their source.
CELLS = 4096
EPOCHS = 3


def default_weight(rank: Column) -> Column:
    return ((rank - 1) % 3 + 1).cast("double")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, source_size, n) to the same with weight and target.

    Sources are ranked by code point, null last, and weigh 1, 2, 3, repeating. Targets share the sum of all sizes; none
    is above EPOCHS times its source's size, and what is cut off is shared by weight among the rest. The cut-off level L
    (target = min(cap, L * weight)) comes from running sums over sources in order of cap / weight. One row a source.
    """
    everything = Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", default_weight(F.col("rank"))).withColumn("cap", (EPOCHS * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("open_weight"))
    # the first source in this order that the level leaves uncapped sets it for all after it
    s = s.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    return s.withColumn("target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))).select("source", "source_size", "n", "total", "weight", "target", "rank")


def plan(sizes: DataFrame, slots: int = SLOTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Targets with the blocks of each source: n_blocks blocks of source_size / n_blocks words, and its share of the slots."""
    t = targets(sizes)
    block = F.greatest(F.lit(1.0), F.least(F.lit(float(block_words)), F.col("total") / slots))
    t = t.withColumn("n_blocks", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long"))
    t = t.withColumn("want", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("upper", F.sum("want").over(upto)).withColumn("lower", F.col("upper") - F.col("want"))


def schedule(plan: DataFrame) -> DataFrame:
    """(slot, source, rank in source, block): slot i goes to the source whose stretch of the cumulative weights holds the
    golden-ratio point frac((i + 0.5) * GOLDEN). Ranks come from counts by piece of 65,536 slots, so no source is ranked
    in one task. A source's blocks are used in order, again from the first after the last, EPOCHS times at most.
    """
    spark = plan.sparkSession
    ends = plan.where("want > 0")
    total = float(ends.agg(F.max("upper")).first()[0] or 0.0)
    slots = int(-(-total // 1))
    cell = lambda c: F.least(F.lit(CELLS - 1), F.floor(c / F.lit(total or 1.0) * CELLS)).cast("int")
    ends = ends.select(F.col("rank").alias("src"), "source", "n_blocks", "lower", "upper", F.explode(F.sequence(cell(F.col("lower")), cell(F.col("upper")))).alias("cell"))
    i = spark.range(0, slots, 1, max(1, slots // 65536)).withColumn("u", ((F.col("id") + 0.5) * GOLDEN) % 1.0 * F.lit(total)).withColumn("cell", cell(F.col("u")))
    i = i.join(ends, "cell").where((F.col("u") >= F.col("lower")) & ((F.col("u") < F.col("upper")) | (F.col("upper") >= total)))
    i = i.select(F.col("id").alias("slot"), F.expr("id div 65536").alias("piece"), "src", "source", "n_blocks")
    counts = i.groupBy("src", "piece").agg(F.count("*").alias("k"))
    earlier = Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src", "piece", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("base"))
    i = i.join(counts, ["src", "piece"])
    i = i.withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("src", "piece").orderBy("slot")) - 1)
    return i.where(F.col("rank") < EPOCHS * F.col("n_blocks")).select("slot", "src", "source", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"))


def place(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (source, size, k, ...) with start: the words before it in its source's shuffled order.

    The order is by md5 of the id, cut into pieces by its first digits; piece totals are added up first, then rows
    within pieces, so that the hottest source is spread over as many tasks as it has pieces.
    """
    docs = docs.join(plan.select(F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.col("n") / PIECE_ROWS)))).cast("int").alias("bits"), F.col("source").alias("of"), "rank", "source_size", "target", "n_blocks"), docs["source"].eqNullSafe(F.col("of"))).drop("of")
    docs = docs.withColumn("piece", F.expr("shiftright(cast(conv(substring(k, 1, 6), 16, 10) as bigint), 24 - bits)"))
    sums = docs.groupBy("rank", "piece").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "piece", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "piece").orderBy("k", "doc_id", "size")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    return docs.join(sums, ["rank", "piece"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("pos", F.row_number().over(within))


def mix(docs: DataFrame, slots: int = SLOTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words of each document that the mix takes, repeats counted.

    Every row of docs is returned; a null text has size 0 and is taken 0 times, a null source is a source of its own,
    last in order. Repeated rows count each. Other columns are ignored. Empty table: no rows.
    """
    sized = stash(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size")).withColumn("k", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "sizes")
    p = stash(plan(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), slots, block_words), "plan")
    uses = schedule(p).groupBy("src", "block").agg(F.count("*").alias("uses"))
    placed = place(sized, p).withColumnRenamed("rank", "src")
    # block b of a source holds its words from edge(b) to edge(b + 1)
    d = placed
    span = F.when(F.col("size") > 0, F.sequence(F.expr("least(n_blocks - 1, greatest(0, (cast(start as decimal(38,0)) * n_blocks) div source_size - 1))").cast("long"), F.expr("least(n_blocks - 1, (cast(start + size as decimal(38,0)) * n_blocks) div source_size)").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("block", F.explode_outer(span))
    edge = "cast((cast({0} as decimal(38,0)) * source_size) div n_blocks as bigint)"
    d = d.withColumn("part", F.expr(f"greatest(0, least(start + size, {edge.format('(block + 1)')}) - greatest(start, {edge.format('block')}))"))
    d = d.join(uses, ["src", "block"], "left").withColumn("words", F.coalesce(F.col("part") * F.col("uses"), F.lit(0)))
    return d.groupBy("src", "piece", "pos", "doc_id", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")
