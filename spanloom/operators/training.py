"""Selecting and shaping training rows: quotas, packing, token targets, candidate items, span features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import prob
from spanloom.operators.spans import as_b, overlap_join
from spanloom.operators.splits import digest
from spanloom.operators.vectors import dot
from spanloom.schema import IGNORE, is_pii


def quota_docs(docs: DataFrame, labels: DataFrame, quota: int, background: float, salt: str, cap: int | None = None) -> DataFrame:
    """Documents, in hash order, that hold a label still under its quota among those kept, and a share of all by hash.

    While a label is under its quota every document with it is kept, so its count among the kept is its rank among all:
    the pass in order is a rank within each label. labels: (doc_id, label).
    """
    w = Window.partitionBy("label").orderBy(digest(salt, F.col("doc_id"), ":"), "doc_id")
    chosen = labels.select("doc_id", "label").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).select("doc_id").distinct()
    extra = docs.select("doc_id").where(prob.unit(salt + "+", F.col("doc_id")) < background)
    keep = docs.join(chosen.unionByName(extra).distinct(), "doc_id", "left_semi")
    return keep if cap is None else keep.orderBy(digest(salt, F.col("doc_id"), ":"), "doc_id").limit(cap)


def quota_rows(rows: DataFrame, label: str, key: str, quota: int, total: int, salt: str) -> DataFrame:
    """At most quota rows a label, labels with fewest rows first, until there are total."""
    size = F.count("*").over(Window.partitionBy(label))
    r = rows.withColumn("_n", size).withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(digest(salt, F.col(key)), key))).where(F.col("_r") <= quota)
    return r.orderBy("_n", label, "_r").limit(total).drop("_n", "_r")


def probe_rows(rows: DataFrame, kind: str, count: int, salt: str) -> DataFrame:
    """count rows, as many of each kind, from the documents with most rows first."""
    dense = F.count("*").over(Window.partitionBy("doc_id"))
    r = rows.withColumn("_d", dense)
    r = r.withColumn("_r", F.row_number().over(Window.partitionBy(kind).orderBy(F.col("_d").desc(), digest(salt, F.col("doc_id")), "doc_id")))
    return r.orderBy("_r", kind).limit(count).drop("_d", "_r")


def bucket_batches(rows: DataFrame, key: str, tokens: str, budget: int) -> DataFrame:
    """rows with bucket, a power of two over their tokens, and batch: as many rows of a bucket as its width times them fits."""
    r = rows.withColumn("bucket", prob.power_of_two(F.col(tokens)))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy(key))
    return r.withColumn("batch", F.floor((n - 1) / F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))))


def first_come(spans: Column) -> Column:
    """Of an array of structs (start, end, ..) those, by start and longest first, that begin after the last kept one ends."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["label"].alias("label"))))
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")

    def step(acc: Column, s: Column) -> Column:
        row = F.array(F.struct(s["start"].cast("int").alias("start"), (-s["neg"]).cast("int").alias("end"), s["label"].alias("label")))
        return F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), acc).otherwise(F.concat(acc, row))

    return F.aggregate(order, none, step)


def token_targets(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """tokens (doc_id, i, start, end) with tag: O, or B, I, E, S and the type; any where IGNORE leaves it open."""
    g = gold.where(is_pii(F.col("label"))).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label")).alias("s"))
    flat = g.select("doc_id", F.posexplode(first_come(F.col("s"))).alias("n", "x")).select("doc_id", "n", "x.start", "x.end", "x.label")
    hit = overlap_join(tokens.select("doc_id", "i", "start", "end"), as_b(flat, b_label="label", n="n"))
    w = Window.partitionBy("doc_id", "n")
    hit = hit.groupBy("doc_id", "i").agg(F.min_by(F.struct("n", "b_label"), "n").alias("x")).select("doc_id", "i", "x.n", "x.b_label")
    first, last = F.min("i").over(w), F.max("i").over(w)
    kind = F.when(first == last, "S").when(F.col("i") == first, "B").when(F.col("i") == last, "E").otherwise("I")
    hit = hit.select("doc_id", "i", F.concat_ws("-", kind, "b_label").alias("tag"))
    free = overlap_join(tokens.select("doc_id", "i", "start", "end"), as_b(gold.where(F.col("label") == IGNORE))).select("doc_id", "i", F.lit(True).alias("_free")).distinct()
    t = tokens.join(hit, ["doc_id", "i"], "left").join(free, ["doc_id", "i"], "left")
    return t.withColumn("tag", F.coalesce("tag", F.when(F.col("_free"), "any"), F.lit("O"))).drop("_free")


def shifted_copies(gold: DataFrame, salt: str) -> DataFrame:
    """Each span with one copy whose start or end is moved by one or two characters; empty and negative ones are left out."""
    k = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "start", "end"), F.lit(4)).cast("int")
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, 1), (0, -2))])
    d = gold.withColumn("_m", F.get(moves, k))
    copy = d.select("doc_id", (F.col("start") + F.col("_m.a")).alias("start"), (F.col("end") + F.col("_m.b")).alias("end"), "label", F.lit("shift").alias("kind")).where("start >= 0 and end > start")
    return gold.select("doc_id", "start", "end", "label", F.lit("gold").alias("kind")).unionByName(copy)


def candidate_items(gold: DataFrame, shifts: DataFrame, proposals: DataFrame, excluded: DataFrame, ratio: float, salt: str) -> tuple[DataFrame, DataFrame]:
    """(items, counts): gold without excluded labels, shifted spans, and proposals clear of gold, ratio times as many at most.

    counts: (kind, n), excluded ones among them.
    """
    ok = gold.join(excluded, "label", "left_anti").select("doc_id", "start", "end", "label", F.lit("gold").alias("kind"))
    sh = overlap_join(shifts.where("kind = 'shift'").select("doc_id", "start", "end", "label", "kind"), as_b(gold.join(excluded, "label", "left_semi")), how="left_anti")
    neg = overlap_join(proposals, as_b(gold), how="left_anti").select("doc_id", "start", "end", F.lit(None).cast("string").alias("label"), F.lit("negative").alias("kind"))
    n, m = ok.count(), neg.count()
    share = min(1.0, ratio * n / m) if m else 0.0
    neg = neg.where(prob.unit(salt, F.col("doc_id"), F.col("start"), F.col("end")) < share)
    items = ok.unionByName(sh).unionByName(neg)
    return items, items.groupBy("kind").agg(F.count("*").alias("n")).unionByName(gold.join(excluded, "label", "left_semi").agg(F.lit("excluded").alias("kind"), F.count("*").alias("n")))


def source_inventory(spans: DataFrame) -> DataFrame:
    """(source, nodes): the label nodes that a source annotates. spans: (source, node)."""
    return spans.groupBy("source").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def span_means(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (doc_id, first, last) with mean: average vector of tokens first..last. tokens: (doc_id, i, vector).

    From running sums along the document, so a span costs two rows whatever its length.
    """
    w = Window.partitionBy("doc_id", "dim").orderBy("i")
    t = tokens.select("doc_id", "i", F.posexplode("vector").alias("dim", "x")).withColumn("upto", F.sum(F.col("x").cast("double")).over(w))
    hi = spans.join(t.select("doc_id", F.col("i").alias("last"), "dim", F.col("upto").alias("b")), ["doc_id", "last"])
    lo = t.select("doc_id", (F.col("i") + 1).alias("first"), "dim", F.col("upto").alias("a"))
    j = hi.join(lo, ["doc_id", "first", "dim"], "left").withColumn("m", (F.col("b") - F.coalesce("a", F.lit(0.0))) / (F.col("last") - F.col("first") + 1))
    return j.groupBy("doc_id", "first", "last").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))


def label_probabilities(items: DataFrame, labels: DataFrame, none_logit: float = 0.0, temperature: float = 1.0) -> DataFrame:
    """items (id, vector) with probabilities over labels in order of name, and none last. labels: (label, vector), a dimension."""
    rows = labels.orderBy("label").collect()
    names = [r.label for r in rows]
    logits = [dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in r.vector])) for r in rows]
    p = prob.softmax(F.array(*logits, F.lit(none_logit)), temperature)
    return items.withColumn("probabilities", p).withColumn("labels", F.array(*[F.lit(x) for x in names]))


def labelled_spans(items: DataFrame, canonical: dict[str, str], floor: float = 0.01) -> DataFrame:
    """items (doc_id, start, end, pb, probabilities, labels) to spans: score pb less none, at or above the floor, best label."""
    best = F.get("labels", prob.argmax(F.slice("probabilities", 1, F.size("labels"))))
    s = prob.sensitive_score(F.col("pb"), F.element_at("probabilities", -1), F.array().cast("array<double>"))
    outcome = F.create_map(*[F.lit(x) for kv in canonical.items() for x in kv])
    d = items.withColumn("score", s).withColumn("raw", best).where(F.col("score") >= floor)
    return d.select("doc_id", "start", "end", F.coalesce(outcome[F.col("raw")], F.lit("OTHER_PII")).alias("label"), "raw", "score")


def packed_ranges(questions: DataFrame, shared: int, limit: int) -> DataFrame:
    """questions (window, pos, tokens) with first, last: places after the shared part of their window; fits if within limit."""
    w = Window.partitionBy("window").orderBy("pos")
    last = F.lit(shared) + F.sum("tokens").over(w)
    return questions.withColumn("last", last.cast("int")).withColumn("first", (F.col("last") - F.col("tokens")).cast("int")).withColumn("fits", F.col("last") <= limit)


def checked_answers(rows: DataFrame) -> DataFrame:
    """rows (options, answer map<string, double>) with status: ok if the keys are the options, else error."""
    same = (F.size(F.array_except("options", F.map_keys("answer"))) == 0) & (F.size(F.map_keys("answer")) == F.size("options"))
    return rows.withColumn("status", F.when(F.coalesce(same, F.lit(False)), "ok").otherwise("error"))


def prompt(kind: Column, options: Column, state: Column) -> Column:
    """A question as text: options with codes of two digits, then the state."""
    lines = F.transform(options, lambda o, i: F.concat(F.lpad((i + 1).cast("string"), 2, "0"), F.lit(": "), o))
    return F.concat_ws("\n", F.concat(F.lit("Question: "), kind), F.array_join(lines, "\n"), F.concat(F.lit("Text: "), state))
