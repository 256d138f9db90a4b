"""Toxicity: a weighted finite-state grammar over clauses, with an insult lexicon learned from labelled documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, small_batches
from spanloom.session import stash

# Seed vocabularies of the grammar.
INSULTS = frozenset("bastard clown cretin disgusting dumb fool idiot imbecile loser moron pathetic pig scum stupid trash vermin worthless".split())
THREATS = frozenset("burn crush destroy hurt kill murder punish shoot smash strangle".split())
TARGETS = frozenset("he her him people she their them they this those u you your yours".split())
YOU = frozenset("u you your yours".split())
LINKS = frozenset("am are be been being is was were".split())
NEGATIONS = frozenset("aren't isn't never nobody not wasn't".split())
REPORTS = frozenset("allegedly called calls claimed claims quote quoted quotes reported said says".split())

#: Labelled rows that the lexicon is learned from, at most, of each label.
SAMPLE_ROWS = 1500
#: Stems that chance alone may bring in (this sets how many toxic documents a stem must cover), and the least share of
#: toxic documents among those that a stem is in, as if labels were balanced.
CHANCE, PRECISION = 0.05, 0.985
#: Share of toxic documents among those with a seed insult, taken from so many documents before any is counted.
SEED_SHARE, SEED_DOCS = 0.8, 4
#: Weight of a match by context, and scale of the sum of weights in the score.
NEGATED, REPORTED, TARGETED, SCALE = 0.25, 0.45, 1.25, 1.3
#: Words in which the sum of weights counts in full; in a text of n words it is divided by 1 + n / LENGTH.
LENGTH = 2000
#: Words that a negation reaches, and words between an insult or a threat and what it is aimed at, at most.
REACH, AIM = 3, 4

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[^.!?;:\n]+")


@dataclass(frozen=True)
class Lexicon:
    """Whole words and word beginnings with weights in (0, 1]; a word takes the heaviest that fits.

    aimed: words that have a clean sense as well and weigh only by a target, unless a stem fits too.
    """

    words: dict[str, float]
    stems: dict[str, float]
    aimed: frozenset[str] = frozenset()

    def alone(self, word: str) -> bool:
        return word not in self.aimed or any(word[:n] in self.stems for n in self.lengths)

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if n <= len(word) and (w := self.stems.get(word[:n], 0.0)) > best:
                best = w
        return best

    @property
    def lengths(self) -> tuple[int, ...]:
        return tuple(sorted({len(s) for s in self.stems}))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn the insult lexicon from at most rows documents of each label, the first by hash of doc_id.

    Rows of the held-out fold, without a label or without an id are not learned from. No labels: the seed lexicon.
    """
    lab = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [lab.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in ("toxic = 1", "toxic = 0")]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * rows ids at most
    texts = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    small_batches(docs.sparkSession)
    held = F.pandas_udf(lambda texts: texts.map(lambda t: sorted(beginnings(t))), "array<string>")
    sample = stash(texts.select("doc_id", (F.col("toxic") > 0).alias("toxic"), held(F.col("text").cast("string")).alias("held")), "toxic-sample")
    n = Counter({int(r.toxic): r["count"] for r in sample.groupBy("toxic").count().collect()})
    each = sample.select("doc_id", "toxic", F.explode("held").alias("k"))
    counts = stash(each.groupBy("k").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")), "toxic-counts")
    often = counts.where("bad >= 3").count()
    least = support(often, n)
    seeds = [w + "$" for w in sorted(INSULTS)]
    rows = counts.where((F.col("bad") >= least) | F.col("k").isin(seeds)).collect()  # rows * words of a text / least

    def sets(keys: list[str]) -> dict[str, set[int]]:
        few = docs.sparkSession.createDataFrame([(k,) for k in keys], "k string")
        found = each.where("toxic").join(F.broadcast(few), "k").groupBy("k").agg(F.collect_set("doc_id").alias("ids")).collect()
        return {r.k: set(r.ids) for r in found}

    return choose(n, least, {r.k: r.bad for r in rows}, {r.k: r.good for r in rows}, sets)


def beginnings(text: str) -> set[str]:
    """The words of a text, marked by a final $, and their beginnings of 4 to 9 letters."""
    return {x for w in set(WORD.findall(text.lower())) for x in (*(w[:k] for k in range(4, min(len(w), 9) + 1)), w + "$")}


def support(candidates: int, n: Counter[int]) -> int:
    """Toxic documents that one of so many candidates must be in for chance alone to bring in less than CHANCE of them."""
    q = min(0.9, (n[1] + 1) / (n[0] + n[1] + 2))
    return max(3, math.ceil(math.log((candidates + 1) / CHANCE) / -math.log(q)))


def fit(sample: list[tuple[str, int]]) -> Lexicon:
    """The lexicon of a sample (text, toxic) held in memory."""
    held = [(beginnings(t), int(toxic > 0)) for t, toxic in sample]
    bad, good = (Counter(k for ks, toxic in held if toxic == x for k in ks) for x in (1, 0))
    n = Counter(toxic for _, toxic in held)
    least = support(sum(v >= 3 for v in bad.values()), n)
    return choose(n, least, {k: v for k, v in bad.items() if v >= least or k[:-1] in INSULTS}, good, lambda keys: {k: {i for i, (ks, toxic) in enumerate(held) if toxic and k in ks} for k in keys})


def choose(n: Counter[int], least: int, bad: dict[str, int], good: dict[str, int], sets: Callable[[list[str]], dict[str, set[int]]]) -> Lexicon:
    """Greedy cover of the toxic documents by words and word beginnings that clean documents lack.

    bad, good: toxic and clean documents of each candidate; sets: the toxic documents themselves, asked for once.
    """
    prior = (n[1] + 1) / (n[0] + 1)
    inside = {k: v for k, v in bad.items() if v >= least}
    share = {k: (v + 0.1) / (v + 0.1 + prior * good.get(k, 0)) for k, v in bad.items()}  # as if labels were balanced
    left = sets(sorted(k for k in inside if share[k] >= PRECISION))
    words, stems, proven = {}, {}, set()
    # by the same bound as stems, but of these few words alone
    enough = support(len(INSULTS), n)
    for w in sorted(INSULTS):
        k = w + "$"
        v = bad.get(k, 0)
        if v >= enough and share[k] >= PRECISION:
            proven.add(k)
        weight = 2 * (SEED_DOCS * SEED_SHARE + v) / (SEED_DOCS + v + prior * good.get(k, 0)) - 1
        if weight > 0:
            words[w] = weight
    todo = set().union(*left.values()) if left else set()
    gone: set[str] = set()
    while left:
        # the most new documents; of equals the longest, a whole word last
        k = max(left, key=lambda x: (len(left[x] & todo), not x.endswith("$"), len(x), x))
        if len(left[k] & todo) < least:
            break
        gone.add(k)
        todo -= left.pop(k)
        left = {x: v for x, v in left.items() if len(v & todo) >= least}
    # stems hidden behind others in the same documents count as well if they stand alone as clearly
    for k, v in inside.items():
        if v >= 5 * least and not good.get(k, 0) and not any(k.startswith(x) for x in gone):
            longer = max((inside[x] for x in (k + c for c in "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñçèêà$") if x in inside), default=0)
            if longer < 0.98 * v:
                gone.add(k)
    for k in gone:
        w = min(1.0, max(0.3, 2 * share[k] - 1))
        (words if k.endswith("$") else stems)[k.rstrip("$")] = w
    return Lexicon(words, stems, frozenset(words) - {k.rstrip("$") for k in proven | gone})


#: What a word is to the grammar: an insult that stands alone, one that must be aimed, a threat, a target (its short
#: forms with a verb, "they're", count as linked), a second person, a linking verb, a negation, a reporting verb.
PLAIN = ("insult", "aimed", "threat", "target", "linked target", "you", "linked you", "link", "not", "report", "word")
MATCHES = ("insult", "aimed", "threat")
#: The one match that a path is about is marked.
MARKED = tuple(f"{x}!" for x in MATCHES)
SYMBOLS = PLAIN + MARKED
PERSONS = {"target", "linked target", "you", "linked you"}
YOUS = {"you", "linked you"}


@dataclass(frozen=True)
class Transducer:
    """Weighted transducer: arcs[state][symbol] is a list of (next state, symbol out, weight). No arc: the path ends."""

    start: object
    final: Callable[[object], bool]
    arcs: Callable[[object, str], list[tuple[object, str, float]]]


def mark() -> Transducer:
    """Marks one insult or threat of the clause, each in a path of its own. State 1: done."""
    table = {k: {x: [(k, x, 1.0)] + ([(1, f"{x}!", 1.0)] if x in MATCHES and not k else []) for x in PLAIN} for k in (0, 1)}
    return Transducer(0, lambda k: k == 1, lambda k, x: table[k][x])


def negation() -> Transducer:
    """State k: a negation reaches k words further. A marked word that it reaches is damped."""
    table = {k: {x: [(REACH if x == "not" else max(0, k - 1), x, NEGATED if k and x in MARKED else 1.0)] for x in SYMBOLS} for k in range(REACH + 1)}
    return Transducer(0, lambda k: True, lambda k, x: table[k][x])


def report() -> Transducer:
    """State 1: a reporting verb came before; a marked word that follows is damped."""
    table = {k: {x: [(1 if x == "report" else k, x, REPORTED if k and x in MARKED else 1.0)] for x in SYMBOLS} for k in (0, 1)}
    return Transducer(0, lambda k: True, lambda k, x: table[k][x])


def target() -> Transducer:
    """State: words since a target, since a second person, and since a target with a link verb, AIM + 1 for none near.

    An insult near a target weighs more; one that must be aimed becomes a plain insult by a second person or a link.
    """
    far = AIM + 1

    def step(at: tuple[int, int, int], x: str) -> list[tuple[object, str, float]]:
        since, you, linked = (min(far, k + 1) for k in at)
        now = (0 if x in PERSONS else since, 0 if x in YOUS else you, 0 if x.startswith("linked") or x == "link" and at[0] <= AIM else linked)
        if x == "insult!":
            return [(now, x, TARGETED if since <= AIM else 1.0)]
        if x == "aimed!" and min(you, linked) <= AIM:
            return [(now, "insult!", TARGETED)]
        return [(now, x, 1.0)]

    places = [(a, b, c) for a in range(far + 1) for b in range(far + 1) for c in range(far + 1)]
    table = {at: {x: step(at, x) for x in SYMBOLS} for at in places}
    return Transducer((far, far, far), lambda at: True, lambda at, x: table[at][x])


def awaited(opens: str, closes: set[str], at_once: str | None = None) -> Transducer:
    """A marked word: opens waits AIM words at most for one of closes, at_once needs none. States: before, k words left, done."""
    table: dict[object, dict[str, list[tuple[object, str, float]]]] = {k: {x: [(k, x, 1.0)] for x in SYMBOLS} for k in ("before", "done")}
    for x in MARKED:
        table["before"][x] = [(AIM, x, 1.0)] if x == opens else [("done", x, 1.0)] if x == at_once else []
    for k in range(1, AIM + 1):
        table[k] = {x: [("done", x, 1.0)] if x in closes else [(k - 1, x, 1.0)] if k > 1 else [] for x in SYMBOLS}
    return Transducer("before", lambda s: s == "done", lambda s, x: table[s][x])


def insult() -> Transducer:
    """A marked insult counts as it is; one that must be aimed waits for a second person."""
    return awaited("aimed!", YOUS, "insult!")


def threat() -> Transducer:
    """A marked threat waits for its target."""
    return awaited("threat!", PERSONS)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """a, then b over what a writes: states are pairs, weights multiply."""

    def arcs(s: tuple[object, object], x: str) -> list[tuple[object, str, float]]:
        return [((p, q), z, u * v) for p, y, u in a.arcs(s[0], x) for q, z, v in b.arcs(s[1], y)]

    return Transducer((a.start, b.start), lambda s: a.final(s[0]) and b.final(s[1]), arcs)


def union(a: Transducer, b: Transducer) -> Transducer:
    """A path of a or a path of b."""
    both = (a, b)

    def arcs(s: object, x: str) -> list[tuple[object, str, float]]:
        if s == "start":
            return [((i, p), y, w) for i, t in enumerate(both) for p, y, w in t.arcs(t.start, x)]
        return [((s[0], p), y, w) for p, y, w in both[s[0]].arcs(s[1], x)]

    return Transducer("start", lambda s: s != "start" and both[s[0]].final(s[1]), arcs)


class Machine:
    """A composed transducer with numbered states; arcs are worked out once, when first met.

    run() adds up, over all paths that end in a final state, the product of arc weights and of the lexicon's weight of
    the marked word: a path marks one insult or one threat, so the sum is over matches.
    """

    def __init__(self, t: Transducer):
        self.t, self.ids, self.states, self.table = t, {t.start: 0}, [t.start], {}

    def arcs(self, state: int, symbol: str) -> list[tuple[int, bool, float]]:
        key = state, symbol
        if key not in self.table:
            out = []
            for s, y, w in self.t.arcs(self.states[state], symbol):
                if s not in self.ids:
                    self.ids[s] = len(self.states)
                    self.states.append(s)
                out.append((self.ids[s], y in MARKED, w))
            self.table[key] = out
        return self.table[key]

    def run(self, symbols: list[tuple[str, float]]) -> float:
        now = {0: 1.0}
        for x, weight in symbols:
            after: dict[int, float] = {}
            for s, v in now.items():
                for q, match, w in self.table.get((s, x)) or self.arcs(s, x):
                    after[q] = after.get(q, 0.0) + v * w * (weight if match else 1.0)
            now = after
        return sum(v for s, v in now.items() if self.t.final(self.states[s]))


class Grammar:
    """Words to symbols by the lexicon; clauses by the composition of mark, negation, report, target and insult or threat."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.lengths = lexicon, lexicon.lengths
        self.machine = Machine(reduce(compose, (mark(), negation(), report(), target(), union(insult(), threat()))))
        self.known: dict[str, tuple[str, float]] = {}

    def tag(self, word: str) -> tuple[str, float]:
        if (w := self.lexicon.weight(word)) > 0:
            return ("insult" if self.lexicon.alone(word) else "aimed"), w
        name, _, verb = word.replace("’", "'").partition("'")
        if word in THREATS:
            return "threat", 1.0
        if name in TARGETS:
            return ("linked " if verb in ("re", "s") else "") + ("you" if name in YOU else "target"), 0.0
        for symbol, group in (("link", LINKS), ("not", NEGATIONS), ("report", REPORTS)):
            if word in group:
                return symbol, 0.0
        return "word", 0.0

    def symbol(self, word: str) -> tuple[str, float]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[word] = self.tag(word)
        return got

    def clause(self, words: list[str]) -> float:
        symbols = [self.symbol(w) for w in words]
        return self.machine.run(symbols) if any(x in MATCHES for x, _ in symbols) else 0.0

    def may_match(self, words: set[str]) -> bool:
        lex = self.lexicon
        if not words.isdisjoint(lex.words) or not words.isdisjoint(THREATS):
            return True
        return any(not lex.stems.keys().isdisjoint({w[:n] for w in words}) for n in self.lengths)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score in 0..1 and the matched clauses as (start, end, weight), offsets in code points of the text."""
        if not text or not self.may_match(set(WORD.findall(text.lower()))):
            return 0.0, []
        found, n = [], 0
        for m in CLAUSE.finditer(text):
            words = WORD.findall(m[0].lower())
            n += len(words)
            if (w := self.clause(words)) > 0:
                found.append((m.start(), m.end(), w))
        return 1 - math.exp(-SCALE * sum(x[2] for x in found) / (1 + n / LENGTH)), found


def score(docs: DataFrame, lexicon: Lexicon, names: tuple[str, str] = ("score", "clauses")) -> DataFrame:
    """Every row of docs with score double and clauses array<struct<start, end, weight>>, under these names.

    Null and empty texts score 0. Columns of docs that have these names are replaced; all others pass through, whatever
    they are called. Texts are read whole; a batch holds few texts, so memory follows the longest ones. A match weighs
    less in a long text (LENGTH). Repeated rows are scored each; ties don't arise. Empty table: no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<score: double, clauses: array<struct<start: int, end: int, weight: double>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon)
        for texts in batches:
            found = [grammar.score(t) for t in texts]
            yield pd.DataFrame({"score": [x[0] for x in found], "clauses": [[{"start": a, "end": b, "weight": w} for a, b, w in x[1]] for x in found]})

    docs = docs.drop(*names)
    both = fresh(docs, "toxic")
    out = docs.withColumn(both, run(F.col("text").cast("string")))
    return out.select(*docs.columns, F.col(f"{both}.score").alias(names[0]), F.col(f"{both}.clauses").alias(names[1]))
