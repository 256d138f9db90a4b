"""Similarity of embedded labels or rows: nearest neighbours of a stated query set, retrieval scores, held-out choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_unit(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with unit: the vector at length 1; a zero vector stays."""
    size = F.sqrt(dot(F.col(vector), F.col(vector)))
    return rows.withColumn("_n", size).withColumn("unit", F.when(F.col("_n") > 0, F.transform(vector, lambda x: x.cast("double") / F.col("_n"))).otherwise(F.transform(vector, lambda x: x.cast("double")))).drop("_n")


#: Queries that are compared in one matrix, at most; rows of a pack, and of one product; bytes of an Arrow batch of packs with
#: their matrices.
QUERIES, PACK, SLICE, BYTES = 1 << 13, 1 << 12, 1 << 9, 1 << 25


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = QUERIES) -> DataFrame:
    """(query_id, id, cosine, rank): the k nearest rows of each query; queries (query_id, unit), rows (id, unit).

    All rows are compared with the stated queries, as products of a pack of rows with a block of queries. A task keeps the k
    best of each query over all its packs, but the matrix of one block alone, and those of all tasks meet at the end. A single
    block is sent to the tasks, as it has a bounded size; of several, each is joined to a copy of the packed rows. So a
    worker holds one product of at most block by SLICE and BYTES of packs at once, whatever the tables' size. Equal cosines
    (to 12 digits) go by id; a row isn't compared with the query of its own id. Vectors are alike in length.
    """
    queries.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", PACK)
    queries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    ids, of = rows.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-queries.count() // block))
    q = queries.select("query_id", F.col("unit").cast("array<double>").alias("unit"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    q = q.groupBy("block").agg(F.collect_list("query_id").alias("query_ids"), F.flatten(F.collect_list("unit")).alias("matrix"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                flat = b.column(1).flatten()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (b.column(0), flat)], names=["ids", "m"])

    r = rows.select("id", F.col("unit").cast("array<double>").alias("unit")).mapInArrow(pack, f"ids array<{ids}>, m array<double>")
    r = r.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    j = r.join(F.broadcast(q) if blocks == 1 else q, "block").select("block", "ids", "m", "query_ids", "matrix")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        block, matrix, place = None, None, {}
        for b in batches:
            for i in range(len(b)):
                n, own = b.column(0)[i].as_py(), np.array(b.column(1)[i].values.to_pylist(), dtype=object)
                if n != block:
                    block, names = n, b.column(3)[i].values.to_pylist()
                    matrix, place = b.column(4)[i].values.to_numpy().reshape(len(names), -1).copy(), {x: j for j, x in enumerate(names)}
                    kept.setdefault(n, (np.array(names, dtype=object), np.empty((len(names), 0)), np.empty((len(names), 0), object)))
                m = b.column(2)[i].values.to_numpy().reshape(len(own), -1)
                for at in range(0, len(own), SLICE):
                    few = own[at:at + SLICE]
                    s = matrix @ m[at:at + SLICE].T
                    same = [(place[x], j) for j, x in enumerate(few) if x in place]
                    if same:
                        s[tuple(np.array(same).T)] = -np.inf
                    kept[n] = kept[n][0], *top(s, few, kept[n][1:], k)
        for names, s, own in kept.values():
            ok = np.isfinite(s)
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(names, ok.sum(1)).tolist(), "id": own[ok].tolist(), "cosine": s[ok]}, schema=schema)

    schema = pa.schema([("query_id", to_arrow_type(queries.schema["query_id"].dataType)), ("id", to_arrow_type(rows.schema["id"].dataType)), ("cosine", pa.float64())])
    some = j.mapInArrow(best, f"query_id {of}, id {ids}, cosine double")
    order = [F.col("cosine").desc(), F.col("id")]
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def top(s: np.ndarray, own: np.ndarray, before: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line of s, to 12 digits, and of those kept before, by score and then id.

    A line that holds nothing as good as what was kept is left at once. own: the ids of the columns of s.
    """
    full = before[0].shape[1] >= k
    least = before[0].min(axis=1) - 1e-11 if full else np.full(len(s), -np.inf)
    width = min(k, s.shape[1] + before[0].shape[1])
    out = tuple(x.copy() for x in before) if full else (np.empty((len(s), width)), np.empty((len(s), width), object))
    for i in np.flatnonzero(s.max(axis=1) >= least):
        line = s[i]
        at = np.flatnonzero(line >= max(least[i], -np.partition(-line, k - 1)[k - 1] - 1e-11 if len(line) > k else -np.inf))
        score, names = np.concatenate([before[0][i], np.round(line[at], 12)]), np.concatenate([before[1][i], own[at]])
        order = sorted(range(len(score)), key=lambda j: (-score[j], names[j]))[:width]
        out[0][i], out[1][i] = score[order], names[order]
    return out


def best_of_other_group(labels: DataFrame) -> DataFrame:
    """(id, best): greatest cosine to a label of another node. labels (id, node, unit) is of dimension size: one row a label."""
    a, b = labels.select("id", "node", F.col("unit").alias("_a")), labels.select(F.col("node").alias("other"), F.col("unit").alias("_b"))
    nodes = sorted(r.node for r in labels.select("node").distinct().collect())
    pairs = a.withColumn("other", F.explode(F.array_except(F.array(*[F.lit(x) for x in nodes]), F.array("node"))))
    return pairs.join(b, "other").groupBy("id").agg(F.max(dot(F.col("_a"), F.col("_b"))).alias("best"))


def retrieval(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (n, top1, top5): texts (query_id, label, unit) against labels (id, unit)."""
    r = nearest(texts, labels, 5).join(texts.select("query_id", "label"), "query_id")
    hit = r.groupBy("query_id").agg(F.max(((F.col("id") == F.col("label")) & (F.col("rank") == 1)).cast("int")).alias("a"), F.max((F.col("id") == F.col("label")).cast("int")).alias("b"))
    return hit.agg(F.count("*").alias("n"), F.avg("a").alias("top1"), F.avg("b").alias("top5"))


def projection_gap(labels: DataFrame) -> DataFrame:
    """One row (heldout_nearest_seen, seen_nearest_other_seen, gap) of labels (id, seen, unit).

    Means of the cosine to the nearest seen label, of held-out ones and of seen ones to another. The more a projection
    collapses held-out labels onto seen ones, the nearer the gap is to what a seen label has, or above. Null without any.
    """
    seen, held = labels.where("seen"), labels.where("not seen")
    near = lambda d, name: nearest(d.select(F.col("id").alias("query_id"), "unit"), seen.select("id", "unit"), 1).agg(F.lit(1).alias("_one"), F.avg("cosine").alias(name))
    j = near(held, "heldout_nearest_seen").join(near(seen, "seen_nearest_other_seen"), "_one").drop("_one")  # one row each
    return j.withColumn("gap", F.col("heldout_nearest_seen") - F.col("seen_nearest_other_seen"))


def choose_held_out(groups: DataFrame, support: int, vetoes: list[str], k: int) -> DataFrame:
    """groups (label, best, support): the k most separate ones with enough support, without vetoed labels."""
    ok = groups.where((F.col("support") >= support) & ~F.col("label").isin(*vetoes))
    return ok.withColumn("rank", F.row_number().over(Window.orderBy("best", "label"))).where(F.col("rank") <= k)


def gold_rank(rows: DataFrame) -> DataFrame:
    """rows (id, scores array, gold index) with rank: one more than the options above the gold one."""
    return rows.withColumn("rank", F.size(F.filter("scores", lambda x: x > F.get(F.col("scores"), F.col("gold")))) + 1)


def rank_summary(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count("*").alias("n"), F.percentile("rank", F.lit(0.5)).alias("median_rank"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"))
