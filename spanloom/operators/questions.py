"""Typed questions about spans and documents, answers as probability vectors, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import prob
from spanloom.operators.spans import as_b, overlap_join
from spanloom.operators.splits import first_by_hash

NONE = "not personal information"


def option_set(target: Column, vocabulary: Column, salt: str, key: Column, least: int, most: int) -> Column:
    """struct(options, target): the target or, for a null one, none of them, with distractors, in an order by hash.

    Both cases draw the count, the distractors, the wording of NONE and the order alike. vocabulary: array<string> of
    names that may stand beside the target.
    """
    n = F.lit(least) + F.pmod(F.xxhash64(F.lit(salt + "n"), key), F.least(F.lit(most), F.size(vocabulary) + 1) - least + 1)
    mixed = lambda a, s: F.transform(F.sort_array(F.transform(a, lambda x: F.struct(F.xxhash64(F.lit(salt + s), key, x).alias("h"), x.alias("x")))), lambda r: r["x"])
    rest = mixed(vocabulary, "d")
    names = F.when(target.isNull(), F.concat(F.slice(rest, 1, (n - 1).cast("int")), F.array(F.lit(NONE)))).otherwise(
        F.concat(F.array(target), F.slice(rest, 1, F.greatest(n - 2, F.lit(0)).cast("int")), F.array(F.lit(NONE))))
    options = mixed(names, "o")
    return F.struct(options.alias("options"), (F.array_position(options, F.coalesce(target, F.lit(NONE))) - 1).cast("int").alias("target"))


def eligible(gold: DataFrame, held: DataFrame) -> DataFrame:
    """Gold spans that are no held-out label (raw) and overlap none in their document."""
    bad = gold.join(held.select("raw"), "raw", "left_semi")
    return overlap_join(gold.join(held.select("raw"), "raw", "left_anti"), as_b(bad), how="left_anti")


def span_questions(gold: DataFrame, candidates: DataFrame, held: DataFrame, vocabulary: DataFrame, compatible: DataFrame, salt: str, least: int = 2, most: int = 8) -> DataFrame:
    """(doc_id, start, end, kind, options, target): a choice for each eligible span, and one for each candidate span that
    overlaps no gold, with none as its answer. vocabulary (raw): distractors; compatible (a, b): names that fit both ways.
    """
    words = vocabulary.agg(F.array_sort(F.collect_set("raw")).alias("v"))  # one row, as long as the vocabulary
    clash = compatible.groupBy(F.col("a").alias("raw")).agg(F.collect_set("b").alias("fits"))
    key = F.concat_ws(":", "doc_id", "start", "end")
    v = F.array(*[F.lit(x) for x in words.first()[0]]).cast("array<string>")
    pos = eligible(gold, held).join(clash, "raw", "left").withColumn("q", option_set(F.col("raw"), F.array_except(v, F.coalesce("fits", F.array("raw"))), salt, key, least, most))
    neg = overlap_join(candidates, as_b(gold), how="left_anti").withColumn("q", option_set(F.lit(None).cast("string"), v, salt, key, least, most))
    pick = lambda d, kind: d.select("doc_id", "start", "end", F.lit(kind).alias("kind"), "q.options", "q.target")
    return pick(pos, "positive").unionByName(pick(neg, "hard_negative"))


def document_questions(docs: DataFrame, gold: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, kind, target): yes/no and a 5-level score for documents without a held-out span."""
    bad = gold.join(held.select("raw"), "raw", "left_semi").select("doc_id").distinct()
    n = gold.groupBy("doc_id").agg(F.count("*").alias("n"))
    d = docs.select("doc_id").join(bad, "doc_id", "left_anti").join(n, "doc_id", "left").na.fill(0, ["n"])
    yes, level = (F.col("n") > 0).cast("int"), F.least(F.lit(4), F.col("n")).cast("int")
    return d.select("doc_id", F.explode(F.array(F.struct(F.lit("noul").alias("kind"), yes.alias("target")), F.struct(F.lit("score").alias("kind"), level.alias("target")))).alias("q")).select("doc_id", "q.*")


def evaluation_questions(positives: DataFrame, negatives: DataFrame, salt: str) -> DataFrame:
    """All positives and, by hash, as many negatives at most."""
    n = positives.count()
    neg = first_by_hash(negatives, n, F.sha2(F.concat_ws("|", F.lit(salt), "doc_id", "start", "end"), 256), "doc_id", "start", "end")
    return positives.withColumn("negative", F.lit(False)).unionByName(neg.withColumn("negative", F.lit(True)))


def leaks(questions: DataFrame, held: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(doc_id, reason): questions that show a held-out name or ask about a forbidden range; must be empty."""
    names = questions.withColumn("name", F.explode("options")).join(held.select(F.col("raw").alias("name")), "name", "left_semi").select("doc_id", F.lit("held-out name").alias("reason"))
    return names.unionByName(overlap_join(questions.select("doc_id", "start", "end"), as_b(forbidden), how="left_semi").select("doc_id", F.lit("forbidden range").alias("reason")))


def answers(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """rows (.., type, options, values, probabilities): normalised, with confidence, choice, score and abstained.

    The first of equal options is chosen; score questions get their expected value. An invalid vector raises.
    """
    fault = prob.fault_of(F.col("probabilities"), F.size("options"))
    p = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("invalid probability vector: "), fault))).otherwise(prob.normalised(F.col("probabilities")))
    d = rows.withColumn("probabilities", p)
    d = d.withColumn("confidence", prob.confidence(F.col("probabilities"))).withColumn("choice", F.get("options", prob.argmax(F.col("probabilities"))))
    d = d.withColumn("score", F.when(F.col("type") == "score", prob.expected(F.col("probabilities"), F.col("values"))))
    return d.withColumn("abstained", F.coalesce(F.col("confidence") < threshold, F.lit(False)) if threshold is not None else F.lit(False))


def redaction_score(answered: DataFrame) -> DataFrame:
    """1 - P(none); null where the answer abstains."""
    at = F.array_position("options", NONE)
    none = F.when(at == 0, F.raise_error(F.lit(f"missing option {NONE}"))).otherwise(F.get("probabilities", (at - 1).cast("int")))
    return answered.withColumn("redaction", F.when(~F.col("abstained"), 1 - none))


def probability_metrics(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """One row (micro, macro, none_accuracy, ece): rows (label, target, probabilities); label null for negatives."""
    d = rows.withColumn("p", prob.retempered(F.col("probabilities"), temperature)).withColumn("ok", (prob.argmax(F.col("p")) == F.col("target")).cast("double")).withColumn("top", F.array_max("p"))
    one = F.lit(1).alias("_one")  # each of the three is one row
    macro = d.where("label is not null").groupBy("label").agg(F.avg("ok").alias("a")).agg(one, F.avg("a").alias("macro"))
    flat = d.agg(one, F.avg("ok").alias("micro"), F.avg(F.when(F.col("label").isNull(), F.col("ok"))).alias("none_accuracy"))
    bins = d.groupBy(F.least(F.floor(F.col("top") * 15), F.lit(14)).alias("b")).agg(F.count("*").alias("k"), F.avg("top").alias("c"), F.avg("ok").alias("y"))
    ece = bins.agg(one, (F.sum(F.col("k") * F.abs(F.col("c") - F.col("y"))) / F.sum("k")).alias("ece"))
    return flat.join(macro, "_one").join(ece, "_one").drop("_one")


def forced_choice(rows: DataFrame, drop: int) -> DataFrame:
    """Macro accuracy if option index `drop` can't be chosen."""
    p = F.transform("probabilities", lambda x, i: F.when(i == drop, -1.0).otherwise(x))
    d = rows.where("label is not null").withColumn("ok", (prob.argmax(p) == F.col("target")).cast("double"))
    return d.groupBy("label").agg(F.avg("ok").alias("a")).agg(F.avg("a").alias("macro"))


def sanity(rows: DataFrame) -> DataFrame:
    """(kind, n, accuracy, top_share, pick_rate_none) with collapsed: one answer for nearly all, or never or always none."""
    pick = prob.argmax(F.col("probabilities"))
    d = rows.withColumn("pick", F.get("options", pick)).withColumn("ok", (pick == F.col("target")).cast("double"))
    top = d.groupBy("kind", "pick").agg(F.count("*").alias("k")).groupBy("kind").agg((F.max("k") / F.sum("k")).alias("top_share"))
    g = d.groupBy("kind").agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"), F.avg((F.col("pick") == NONE).cast("double")).alias("none_rate")).join(top, "kind")
    return g.withColumn("collapsed", (F.col("top_share") > 0.95) | (F.col("none_rate") == 1))


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """One row (n, micro, macro, majority) of rows (label, said)."""
    per = rows.groupBy("label").agg(F.count("*").alias("k"), F.avg((F.col("said") == F.col("label")).cast("double")).alias("a"))
    return per.agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.coalesce("a", F.lit(0.0))) / F.sum("k")).alias("micro"), F.avg(F.coalesce("a", F.lit(0.0))).alias("macro"), (F.max("k") / F.sum("k")).alias("majority"))


def top_predictions(rows: DataFrame, k: int = 3) -> DataFrame:
    """(label, said, n, rank): what each label is most often taken for."""
    c = rows.groupBy("label", "said").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.col("n").desc(), "said"))).where(F.col("rank") <= k)


def composition(questions: DataFrame) -> DataFrame:
    """(kind, n, share, dominant, dominant_share): how a selection is made up."""
    lab = questions.groupBy("kind", "label").agg(F.count("*").alias("k"))
    g = lab.groupBy("kind").agg(F.sum("k").alias("n"), F.max_by("label", F.struct("k", "label")).alias("dominant"), F.max("k").alias("top"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("dominant_share", F.col("top") / F.col("n")).drop("top")  # one row a kind


def windows_of(questions: DataFrame, state: str, size: int = 64) -> DataFrame:
    """questions (doc_id, state, options, pos) with window: chunks of size in order within equal document, state and options."""
    w = Window.partitionBy("doc_id", state, "options").orderBy("pos")
    return questions.withColumn("window", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def restyled(options: Column, spaces: bool = False, none_description: str | None = None) -> Column:
    """options (array of struct name, description) worded otherwise: names with spaces, another description of NONE."""
    def one(o: Column) -> Column:
        name = F.replace(o["name"], F.lit("_"), F.lit(" ")) if spaces else o["name"]
        text = o["description"] if none_description is None else F.lit(none_description)
        return F.when(o["name"] == NONE, F.struct(o["name"].alias("name"), text.alias("description"))).otherwise(F.struct(name.alias("name"), o["description"].alias("description")))

    return F.transform(options, one)


def path_comparison(rows: DataFrame) -> DataFrame:
    """One row (n, max_abs_diff, argmax_agree) of rows (a, b): probabilities of the same questions by two ways of computing."""
    far = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return rows.agg(F.count("*").alias("n"), F.max(far).alias("max_abs_diff"), F.avg((prob.argmax(F.col("a")) == prob.argmax(F.col("b"))).cast("double")).alias("argmax_agree"))


def answer_errors(rows: DataFrame) -> DataFrame:
    """(reason, n): answers (options, answer map<string, double>, error) that can't be used, by the error that the model
    named, else invalid_answer: other keys than the options, or values that are no probabilities."""
    p = F.transform("options", lambda o: F.element_at("answer", o))
    bad = F.col("answer").isNull() | (F.size("answer") != F.size("options")) | prob.fault_of(p, F.size("options")).isNotNull()
    return rows.where(bad).groupBy(F.coalesce("error", F.lit("invalid_answer")).alias("reason")).agg(F.count("*").alias("n"))


def weighted_mean(rows: DataFrame, value: str = "loss", n: str = "questions") -> DataFrame:
    return rows.agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("mean"))


def model_size(rows: DataFrame, accuracy_margin: float, ece_bound: float, latency_bound: float) -> DataFrame:
    """The smallest size (size, accuracy, ci_low, ece, p95) within all bounds of the best one; no row if none is."""
    best = F.max("accuracy").over(Window.partitionBy())
    ok = rows.withColumn("_best", best).where((F.col("accuracy") >= F.col("_best") - accuracy_margin) & (F.col("ece") <= ece_bound) & (F.col("p95") <= latency_bound))
    return ok.orderBy("size").limit(1).drop("_best")
