"""Quality rules as a short-circuit cascade ordered by rejection per cost. DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACES, fresh, let, words
from spanloom.session import stash

#: Rows of the sample on which costs and selectivities are estimated, at most.
SAMPLE_ROWS = 1000
#: Times that a rule is applied to each row of the sample while it is timed, at first; times it grows; applications at most.
REPEAT, GROWTH, MOST = 4, 16, 1 << 22
#: Seconds a row below which rules count as equally cheap.
RESOLUTION = 5e-7
#: A rule's own time counts once it is so many times the spread of the same job without a rule, and so large a part of it.
CLEAR, PART = 4, 0.5
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A document fails if the expression, over the metric columns and text, is true."""

    name: str
    fails: str


# Production rules. Comparisons stay in whole numbers, so that any engine agrees.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("word_length_low", "word_chars < 2 * n_words"),
    Rule("word_length_high", "word_chars > 20 * n_words"),
    Rule("shouting", "2 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > word_chars"),
    Rule("exclaimed", "2 * (length(text) - length(replace(text, '!', ''))) > n_words"),
    Rule("few_letters", "2 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < word_chars"),
)


def repeated_words(w: Column) -> Column:
    """Words of a word array (bound by let()) in 3-word windows found twice or more, the first included."""
    def window(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)])

    at = F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0)))
    quick = let(F.transform(at, lambda i: F.xxhash64(window(i))), lambda h: F.size(F.array_distinct(h)) == F.size(h))

    def exact(s: Column) -> Column:  # s: (window, position) in order of window
        twice = F.filter(s, lambda x, j: (x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]))
        covered = F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(WINDOW)])))
        return F.size(F.array_distinct(covered))

    # eqNullSafe is not needed: get() beyond the ends is null, and null or false drops the row
    slow = let(F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("g"), i.alias("i")))), exact)
    return F.when((F.size(w) < WINDOW) | quick, F.lit(0)).otherwise(slow).cast("long")


def metrics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), over whole texts."""
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.drop(*own)
    kept = d.columns
    in_lines, in_words = fresh(d, "lines"), fresh(d, "words")
    dense = F.length(F.translate(text, SPACES, ""))
    d = d.withColumn("word_chars", dense.cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0), lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))
    d = d.withColumn(in_lines, lines).withColumn(in_words, let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))))
    return d.select(*kept, F.col(f"{in_words}.n").alias("n_words"), "word_chars", "n_symbols", F.col(f"{in_lines}.n").alias("n_lines"), F.col(f"{in_lines}.dup").alias("n_dup_lines"), F.col(f"{in_words}.r").alias("n_repeat_words"))


BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def estimate(sample: DataFrame, rules: tuple[Rule, ...] = RULES, repeat: int = REPEAT) -> tuple[dict[str, float], list[tuple[bool, ...]]]:
    """Seconds a row of each rule, and what each rule says of each row of a small stored sample that the base rules pass.

    A rule is timed in a job that applies it to every row `repeat` times, row by row and without copies, less the same job without a rule, so that what a
    job costs besides doesn't count. The repeats grow until the rule's own time stands clear of that job's time and spread;
    the lesser of two such times counts. A rule whose time doesn't show after as many applications as RESOLUTION needs
    costs RESOLUTION, as does any below it: among those rejections alone decide.
    """
    def rejected(r: Rule) -> Column:
        return F.coalesce(F.expr(r.fails), F.lit(False))

    said = [tuple(r) for r in sample.where(f"not ({BASE})").select(*[rejected(r).alias(r.name) for r in rules]).collect()]  # rows of the sample
    rows = max(1, sample.count())

    def seconds(condition: Column, times: int) -> float:
        often = F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.lit(0).cast("long"), lambda n, i: n + condition.cast("long"))
        t = time.perf_counter()
        sample.agg(F.sum(often)).collect()
        return time.perf_counter() - t

    without: dict[int, list[float]] = {}

    def cost(condition: Column) -> float:
        times = max(1, repeat)
        seconds(condition, 1)  # compiled from here on
        while True:
            if times not in without:
                without[times] = sorted(seconds(F.col("n_words") < 0, times) for _ in range(4))
            empty, worst = without[times][0], without[times][2]
            need = max(CLEAR * (worst - empty), PART * empty)
            own = seconds(condition, times) - empty
            if own > need:
                return max((min(own, seconds(condition, times) - empty)) / (rows * times), RESOLUTION)
            if need < RESOLUTION * rows * times or rows * times >= MOST:
                return RESOLUTION
            times *= max(2, min(GROWTH, round(2 * need / max(own, need / GROWTH))))

    costs = {r.name: cost(rejected(r)) for r in rules}
    return costs, said


def cascade(rules: tuple[Rule, ...], costs: dict[str, float], said: list[tuple[bool, ...]]) -> list[Rule]:
    """The next rule is the one that rejects most per second of what the rules before it let through, the cheapest of equals.

    said: for each sampled row, what each rule says. Rules that reject nothing of what is left come last, cheapest first.
    """
    left, todo, order = list(said), list(range(len(rules))), []
    while todo:
        hits = {j: sum(x[j] for x in left) for j in todo}
        j = min(todo, key=lambda j: (-hits[j] / costs[rules[j].name], costs[rules[j].name]))
        order.append(rules[j])
        todo.remove(j)
        left = [x for x in left if not x[j]]
    return order


def apply(measured: DataFrame, order: list[Rule]) -> DataFrame:
    """Adds base_failed and kept. CASE stops at the first rule that rejects, so later and dearer ones aren't evaluated."""
    case = " ".join(f"when {r.fails} then false" for r in order)
    d = measured.withColumn("base_failed", F.expr(BASE))
    return d.withColumn("kept", F.expr(f"case when base_failed then false {case} else true end"))


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, repeat: int = REPEAT) -> list[Rule]:
    """The cascade for docs, from at most rows of them, the first by hash of doc_id."""
    # ids first, so that no text is ordered; a hash stands for the id, as that may be null
    key = fresh(docs, "key")
    ids = docs.select(F.xxhash64("doc_id").alias(key)).distinct().orderBy(key).limit(rows)
    few = docs.select("text", F.xxhash64("doc_id").alias(key)).join(F.broadcast(ids), key, "left_semi").select(F.coalesce("text", F.lit("")).alias("text")).limit(rows)
    few = few.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # the limit leaves one task
    return cascade(rules, *estimate(stash(metrics(few), "rule-sample"), rules, repeat))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of docs with its metrics, base_failed and kept.

    The verdict is that no rule rejects, so the order decides the cost and never the result. Null text: no words, hence
    base_failed. Columns of docs with the names of metrics are replaced. Repeated rows are judged each; empty table: no rows.
    """
    return apply(metrics(docs.withColumn("text", F.coalesce("text", F.lit("")))), ordered(docs, rules, rows))


def clean(docs: DataFrame, order: list[Rule]) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns alone.

    Each rule is a filter of its own, in order. The optimizer moves them below the metrics, so a metric is worked out only
    for rows that reach a rule which needs it, and those that no rule needs not at all.
    """
    text = fresh(docs, "text_as_it_was")
    d = metrics(docs.withColumn(text, F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))))
    for fails in ("n_words < 50", "100 * n_repeat_words > 50 * n_words", *[r.fails for r in order]):
        d = d.where(~F.coalesce(F.expr(fails), F.lit(False)))
    return d.withColumn("text", F.col(text)).select(*[c for c in docs.columns if c in d.columns])
