"""Deterministic splits and samples from salted SHA-256 order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.prob import unit


def digest(salt: str, key: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, F.lit(salt), key.cast("string")), 256)


def first_by_hash(rows: DataFrame, n: int, h: Column, *ties: str) -> DataFrame:
    """The n rows with the least hex digest h, of equal ones by ties. No task orders all rows.

    Rows are counted by the digest's first 4 digits; the pieces that are taken whole, and the one in which the n-th row
    lies, follow from at most 65,536 counts. Only that piece is ordered.
    """
    d = rows.withColumn("_h", h).withColumn("_piece", F.substring("_h", 1, 4))
    left, edge = n, None
    for r in sorted(d.groupBy("_piece").count().collect()):
        if r["count"] > left:
            edge = r["_piece"]
            break
        left -= r["count"]
    if edge is None:
        return d.drop("_h", "_piece")
    inside = d.where(F.col("_piece") == edge).orderBy("_h", *ties).limit(left)
    return d.where(F.col("_piece") < edge).unionByName(inside).drop("_h", "_piece")


def hash_split(docs: DataFrame, cluster: str, frac: float, salt: str) -> DataFrame:
    """docs with part: calib for the first max(1, round half even(frac * clusters)) clusters by hash, else test.

    The cut is a hash value, so documents are compared with it where they lie.
    """
    clusters = docs.select(F.col(cluster).alias("c")).distinct()
    n = clusters.count()
    if not n:
        return docs.withColumn("part", F.lit("calib"))
    first = first_by_hash(clusters, max(1, round(frac * n)), digest(salt, F.col("c")))
    last = first.agg(F.max(digest(salt, F.col("c")))).first()[0]
    return docs.withColumn("part", F.when(digest(salt, F.col(cluster)) <= last, "calib").otherwise("test"))


def stratified_sample(docs: DataFrame, n: int | None, stratum: str, salt: str, key: str = "doc_id") -> DataFrame:
    """n documents in hash order within strata, shared out by size with the largest remainders rounded up, ties by name.

    Documents are counted by stratum and piece of the hash; a piece is ranked in itself, and only those before the
    stratum's share are looked at, so a stratum with most documents is no single task's.
    """
    sizes = docs.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    if n is None or n >= total:
        return docs
    q = sizes.withColumn("_q", F.lit(n) * F.col("_n") / F.lit(total)).withColumn("_base", F.floor("_q"))
    left = n - (q.agg(F.sum("_base")).first()[0] or 0)
    rank = F.row_number().over(Window.orderBy((F.col("_q") - F.col("_base")).desc(), "_s"))  # one row a stratum
    q = q.withColumn("_take", F.col("_base") + F.when(rank <= left, 1).otherwise(0)).select("_s", "_take")
    d = docs.withColumn("_h", digest(salt, F.col(key))).withColumn("_piece", F.substring("_h", 1, 3))
    pieces = d.groupBy(F.col(stratum).alias("_s"), "_piece").agg(F.count("*").alias("_k"))
    upto = Window.partitionBy("_s").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 pieces a stratum
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_k").over(upto), F.lit(0)))
    q = q.withColumnRenamed("_s", "_t")
    pieces = pieces.join(q, pieces["_s"].eqNullSafe(q["_t"])).where(F.col("_before") < F.col("_take")).select("_s", F.col("_piece").alias("_p"), "_before", "_take")
    d = d.join(pieces, d[stratum].eqNullSafe(pieces["_s"]) & (d["_piece"] == pieces["_p"]))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_s", "_p").orderBy("_h", key))
    return d.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_take")).select(*docs.columns)


def dev_slice(docs: DataFrame, group: Column, frac: float, salt: str) -> DataFrame:
    """docs with in_dev: groups, such as twins of one record, stay together."""
    return docs.withColumn("in_dev", unit(salt, group) < frac)


def cluster_sample(docs: DataFrame, cluster: str, target: int, salt: str) -> DataFrame:
    """Whole clusters in hash order until there are target documents at least."""
    sizes = docs.groupBy(F.col(cluster).alias("_c")).agg(F.count("*").alias("_n")).withColumn("_h", digest(salt, F.col("_c"), ":")).withColumn("_piece", F.substring("_h", 1, 3))
    base = running_base(sizes.groupBy("_piece").agg(F.sum("_n").alias("_k")))  # 4,096 pieces of the hash
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_piece").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = sizes.join(base, "_piece").withColumn("_b", F.col("_base") + inside).where(F.col("_b") < target).select("_c")
    return docs.join(chosen, docs[cluster].eqNullSafe(chosen["_c"]), "left_semi")


def running_base(pieces: DataFrame) -> DataFrame:
    """(_piece, _base): what earlier pieces hold. pieces (_piece, _k) are few, whatever the input."""
    return pieces.select("_piece", F.coalesce(F.sum("_k").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))


def weighted_order(rows: DataFrame, label: str, key: str, salt: str, exponent: float = 0.5) -> DataFrame:
    """rows with cycle_key: ascending, it draws without replacement by weight label count ** -exponent."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    u = F.greatest(unit(salt, F.col(key)), F.lit(1e-300))
    return rows.join(counts, label).withColumn("cycle_key", -F.log(u) * F.pow(F.col("_n").cast("double"), F.lit(exponent))).drop("_n")


def draw(rows: DataFrame, count: int, label: str, key: str, salt: str, exponent: float = 0.5) -> DataFrame:
    """count rows by weighted_order; the pool repeats only once it is used up."""
    n = rows.count()
    if not n:
        raise ValueError("cannot draw from an empty pool")
    cycles, rest = divmod(count, n)
    out = None
    for c in range(cycles + (rest > 0)):
        d = weighted_order(rows, label, key, f"{salt}:{c}", exponent)
        if c == cycles:
            d = d.orderBy("cycle_key", key).limit(rest)
        d = d.withColumn("cycle", F.lit(c))
        out = d if out is None else out.unionByName(d)
    return out


def repeated(rows: DataFrame, count: int, key: str, salt: str) -> DataFrame:
    """count rows: hash order, from the first again after the last. Positions come from ranges of the hash, so no task ranks all."""
    n = rows.count()
    h = rows.withColumn("_h", digest(salt, F.col(key))).withColumn("_piece", F.substring("_h", 1, 2))
    base = running_base(h.groupBy("_piece").agg(F.count("*").alias("_k")))  # 256 rows
    h = h.join(base, "_piece").withColumn("slot0", F.col("_base") + F.row_number().over(Window.partitionBy("_piece").orderBy("_h", key)) - 1)
    if not n:
        return h.withColumn("slot", F.lit(0).cast("long")).drop("_h", "_piece", "_base", "slot0")
    slots = F.expr(f"transform(sequence(0L, greatest(0L, (cast({count} as bigint) - 1 - slot0) div {n})), i -> slot0 + i * {n})")
    return h.where(F.col("slot0") < count).withColumn("slot", F.explode(slots)).drop("_h", "_piece", "_base", "slot0")


def balanced_selection(rows: DataFrame, count: int, kind: str, label: str, key: str, salt: str, exponent: float = 0.5) -> DataFrame:
    """The kinds of repeated() slot by slot; rows in positive slots come from draw(), in order."""
    base = repeated(rows, count, key, salt)
    plus = base.where(F.col(kind) == "positive").select("slot")
    k = plus.count()
    if not k:
        return base
    new = draw(rows.where(F.col(kind) == "positive"), k, label, key, salt + "+", exponent)
    w = Window.orderBy("slot")  # at most count rows, one batch of questions
    plus = plus.withColumn("_i", F.row_number().over(w))
    new = new.withColumn("_i", F.row_number().over(Window.orderBy("cycle", "cycle_key", key))).drop("cycle", "cycle_key")
    return base.where(F.col(kind) != "positive").unionByName(new.join(plus, "_i").drop("_i"))


def top_k(rows: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group, with dropped: how many the group lost."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("dropped", F.greatest(F.count("*").over(w) - k, F.lit(0)))
    return r.where(F.col("_n") <= k).drop("_n")


def whole_docs(rows: DataFrame, target: int, key: str, salt: str) -> DataFrame:
    """Rows of whole documents in hash order until there are target rows at least."""
    return cluster_sample(rows, key, target, salt)


def token_batches(rows: DataFrame, key: str, tokens: str, budget: int, pieces: int = 256) -> DataFrame:
    """rows with batch: consecutive rows by a numeric key; a row's batch is the sum before it divided by the budget.

    So no batch holds more than budget plus one row's tokens. Sums run inside pieces between quantiles of the key, after
    the totals of the pieces before.
    """
    cuts = rows.agg(F.percentile_approx(key, F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), 10_000)).first()[0] or []
    r = rows.withColumn("_piece", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(key))) if cuts else F.lit(0))
    base = running_base(r.groupBy("_piece").agg(F.sum(tokens).alias("_k")))
    inside = F.coalesce(F.sum(tokens).over(Window.partitionBy("_piece").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return r.join(base, "_piece").withColumn("batch", F.floor((F.col("_base") + inside) / budget)).drop("_piece", "_base")
