"""Telephone numbers: groups of digits, joined as writers join them, and a numbering plan as one automaton over their digits.

The plan is a table of leading digits and lengths. It is compiled once, on the driver, to an automaton of some hundred
states; in Spark a number costs one array lookup a digit, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import pieces
from spanloom.operators.spans import suppress

# Shapes of public numbering plans. The leading digits of a whole number with its country code (a digit or a
# class of digits a place), and the least and most digits of all. 0, 0: no number begins like that.
RULES = (
    ("1[2-9][0-8][0-9][2-9]", 11, 11), ("1[2-9]11[0-9]", 0, 0),
    ("20[1-9]", 10, 12), ("27[1-8]", 11, 11), ("30[2-9]", 12, 12), ("31[1-578]", 11, 11), ("316", 11, 11), ("32[1-9]", 10, 10), ("324", 11, 11),
    ("33[1-79]", 11, 11), ("338", 11, 11), ("34[6-9]", 11, 11), ("351[239]", 12, 12), ("352[2-9]", 8, 12), ("353[1-9]", 10, 12), ("3538", 12, 12),
    ("354[4-8]", 10, 10), ("358[1-9]", 8, 13), ("36[1-9]", 10, 11), ("390", 8, 13), ("393", 11, 12), ("40[237]", 11, 11), ("41[2-9]", 11, 11),
    ("420[2-7]", 12, 12), ("421[2-9]", 12, 12), ("43[1-9]", 9, 15), ("441", 11, 12), ("442", 12, 12), ("443", 12, 12), ("447[1-57-9]", 12, 12),
    ("448", 11, 12), ("449", 12, 12), ("45[2-9]", 10, 10), ("46[1-9]", 9, 11), ("467", 11, 11), ("47[2-9]", 10, 10), ("48[1-9]", 11, 11),
    ("49[2-9]", 9, 13), ("4915", 13, 13), ("491[67]", 12, 13), ("52[1-9]", 12, 12), ("54[1-9]", 12, 13), ("55[1-9][1-9]", 12, 13), ("56[2-9]", 11, 11),
    ("57[136]", 12, 12), ("61[23478]", 11, 11), ("62[2-9]", 10, 14), ("63[2-9]", 10, 12), ("64[34679]", 10, 10), ("642", 10, 12), ("65[3689]", 10, 10),
    ("66[2-9]", 10, 11), ("7[3489]", 11, 11), ("81[1-9]", 11, 11), ("81[5789]0", 12, 12), ("82[1-6]", 10, 12), ("84[2-9]", 11, 12), ("8610", 12, 12),
    ("86[2-9]", 11, 13), ("861[3-9]", 13, 13), ("852[2-9]", 11, 11), ("886[2-9]", 11, 12), ("90[2-5]", 12, 12), ("91[1-9]", 12, 12), ("92[2-9]", 11, 12),
    ("971[2-79]", 11, 11), ("9715", 12, 12), ("972[2-489]", 11, 11), ("9725", 12, 12),
)
#: Digits of a telephone number with its country code, groups of digits that one is written in, and characters between two.
LEAST, MOST, GROUPS, GAP = 7, 15, 7, 3
# What may stand between two groups of one number; between groups that must not be torn apart; before and
# behind a number.
BETWEEN = r"^(?:[ ./-]|[ .-]?\(|\)[ .-]?|\) \()\z"
TIGHT = r"^[().:-]+\z"
NOT_BEFORE, NOT_BEHIND = r"[\p{L}\p{N}_$£€¥%+#]\z", r"^[\p{L}_%]"


@dataclass(frozen=True)
class Home:
    """How numbers without + are read: own country code, the digit before a national number, the digits before others."""

    code: str = "1"
    trunk: str = "1"
    abroad: str = "011"


@dataclass(frozen=True)
class Plan:
    """step: next state by 10 * state + digit, 0 if the rules know no further digit; sizes: bit n is set if n digits are a number."""

    step: tuple[int, ...]
    sizes: tuple[int, ...]


def places(prefix: str) -> list[frozenset[str]]:
    """The digits that each place of a rule's prefix takes."""
    return [frozenset(d for d in "0123456789" if re.fullmatch(one, d)) for one in re.findall(r"\[[0-9-]+\]|[0-9]", prefix)]


def compiled(rules: tuple[tuple[str, int, int], ...] = RULES) -> Plan:
    """The automaton of all rules at once.

    A state is the places reached in rules that still fit, and the lengths of the rules that read most digits so far. Of
    rules of one length a refusal wins, else their lengths are united.
    """
    read = [(places(p), sum(1 << n for n in range(a, b + 1) if n)) for p, a, b in rules]
    start = frozenset((r, 0) for r in range(len(read))), 0
    number, todo, rows = {start: 0}, deque([start]), []
    while todo:
        live, lengths = todo.popleft()
        row = []
        for d in "0123456789":
            on = [(r, at + 1) for r, at in live if d in read[r][0][at]]
            ended = [read[r][1] for r, at in on if at == len(read[r][0])]
            bits = lengths if not ended else 0 if 0 in ended else reduce(int.__or__, ended)
            new = frozenset(x for x in on if x[1] < len(read[x[0]][0])), bits
            if not on:
                row.append(0)
                continue
            if new not in number:
                number[new] = len(number)
                todo.append(new)
            row.append(number[new])
        rows.append(row)
    return Plan(tuple(x for row in rows for x in row), tuple(bits for _, bits in number))


def valid(digits: Column, plan: Plan) -> Column:
    """Whether digits, country code first, are a number of the plan. Null digits: false."""
    step, sizes = F.lit(list(plan.step)), F.lit(list(plan.sizes))

    def on(state: Column, digit: Column) -> Column:
        # a state that no rule leads on from is kept as its complement
        return F.when(state < 0, state).otherwise(F.coalesce(F.nullif(F.get(step, state * 10 + digit.try_cast("int")), F.lit(0)), -state - 1))

    last = F.aggregate(F.split(digits, ""), F.lit(0), on)
    bits = F.get(sizes, F.when(last < 0, -last - 1).otherwise(last))
    return F.coalesce(F.length(digits).between(LEAST, MOST) & (F.call_function("shiftright", bits, F.length(digits)).bitwiseAND(F.lit(1)) == 1), F.lit(False))


def international(digits: Column, plus: Column, home: Home) -> Column:
    """Digits with their country code: as they are behind +, without the digits for abroad, or with the home code."""
    n = len(home.trunk)
    national = F.when(digits.startswith(home.trunk), F.substring(digits, n + 1, 64)).otherwise(digits) if home.trunk else digits
    return F.when(plus, digits).when(digits.startswith(home.abroad), F.substring(digits, len(home.abroad) + 1, 64)).otherwise(F.concat(F.lit(home.code), national))


def phones(docs: DataFrame, home: Home = Home(), rules: tuple[tuple[str, int, int], ...] = RULES) -> DataFrame:
    """(doc_id, start, end, surface) of numbers of the plan in whole texts, with their + and brackets.

    From each group of digits on, up to GROUPS groups are joined while what is between them is in BETWEEN; the most groups
    that make a number are taken. A number isn't torn out of groups joined by signs without a space (times of day are such groups), nor taken next to
    letters, percent or currency signs. Of numbers that overlap the first stays. A bracketed 0 ("+44 (0) 20") isn't dialled.
    Null and empty texts have none. Rows are the groups of digits of a text, not its characters; a text is dealt out once.
    """
    p = pieces(docs.where(F.col("text").rlike("[0-9]")), "[0-9]+")
    order = Window.partitionBy("doc_id").orderBy("pos")
    gap = ~F.col("hit")
    p = p.select("doc_id", "pos", "start", "hit", (F.col("start") + F.length("piece")).alias("end"),
                 F.when(~gap & (F.length("piece") <= MOST), F.col("piece")).alias("digits"),
                 F.when(gap & (F.length("piece") <= GAP), F.col("piece")).alias("sep"), F.when(gap, F.right("piece", F.lit(GAP))).alias("tail"), F.when(gap, F.left("piece", F.lit(1))).alias("head"))
    # every group stands between two gaps, which may be empty at the ends of the text only
    g = p.withColumns({"before": F.lag("tail").over(order), "sep": F.lag("sep").over(order), "behind": F.lead("head").over(order), "left": F.when(F.col("pos") > 1, F.coalesce(F.lag("sep").over(order), F.lit(""))).otherwise("")}).where("hit")
    g = g.withColumn("right", F.coalesce(F.lead("sep").over(order), F.lit("")))
    unsaid = (F.col("digits") == "0") & F.col("left").endswith("(") & F.col("right").startswith(")")
    g = g.withColumn("one", F.struct(F.when(unsaid, "").otherwise(F.col("digits")).alias("digits"), "sep", "end", "behind", "right"))
    g = g.select("doc_id", "pos", "start", "before", "left", "one", *[F.lead("one", k).over(order).alias(f"g{k}") for k in range(1, GROUPS)])
    g = g.where(F.col("one.digits").isNotNull() & ~F.col("left").rlike(TIGHT))
    each, digits, linked, closed = [], F.col("one.digits"), F.lit(True), F.lit(False)
    for k in range(GROUPS):
        x = F.col("one") if k == 0 else F.col(f"g{k}")
        if k:
            digits, linked = F.concat(digits, x["digits"]), linked & F.coalesce(x["sep"].rlike(BETWEEN), F.lit(False))
            closed = closed | F.coalesce(x["sep"].contains(")"), F.lit(False))
        each.append(F.struct(F.coalesce(linked & (F.length(digits) <= MOST) & ~x["right"].rlike(TIGHT) & ~F.coalesce(x["behind"].rlike(NOT_BEHIND), F.lit(False)), F.lit(False)).alias("ok"), digits.alias("digits"), closed.alias("closed"), x["end"].alias("end")))
    g = g.select("doc_id", "start", F.coalesce("before", F.lit("")).alias("before"), F.filter(F.array(*each), lambda e: e["ok"]).alias("each")).where(F.size("each") > 0)
    plan = compiled(rules)
    sign = lambda closed: F.when(closed & F.col("before").endswith("+("), 2).when(F.col("before").endswith("+") | closed & F.col("before").endswith("("), 1).otherwise(0)
    plus = lambda closed: F.col("before").endswith("+") | closed & F.col("before").endswith("+(")
    clean = lambda closed: ~F.expr("before").substr(F.lit(1), F.length("before") - sign(closed)).rlike(NOT_BEFORE)
    found = F.filter("each", lambda e: clean(e["closed"]) & valid(international(e["digits"], plus(e["closed"]), home), plan))
    g = g.withColumn("best", F.get(found, F.size(found) - 1)).where("best is not null")
    start = F.col("start") - sign(F.col("best.closed"))
    g = g.select("doc_id", start.alias("start"), F.col("best.end").alias("end"), F.lit("PHONE").alias("label"), (-start).cast("double").alias("score"))
    stay = suppress(g).select("doc_id", "start", "end")
    return stay.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("surface"))
