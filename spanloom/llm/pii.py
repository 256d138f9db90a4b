"""Personal data: exact base spans, then bootstrapped contextual extraction on a pattern-instance graph."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import small_batches
from spanloom.session import stash

KINDS = ("email", "ip", "card", "phone", "id")
# The base patterns. A lookbehind, where there is one, only skips starts that can't match, so that long
# runs are read once.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, MAYBE = re.compile(r"[0-9]"), re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W_]+")
LAST = re.compile(r"[^\W_]+(?=[\W_]*$)")

#: Rounds of scoring; least confidence of a pattern to extract by, least worth of an item that supports a pattern as a
#: seed does, and least number of different supporters.
ROUNDS, CONFIDENCE, PROMOTED, SEEDS = 4, 0.3, 0.5, 5
#: Characters of context before a span, characters between its words and the span at most, and shortest unseen identifier.
CONTEXT, GAP, SHORTEST = 64, 4, 6
#: Bits of the filter of wanted patterns, whatever their number; counts and known words that a task holds at most.
BITS, HELD = 1 << 26, 1 << 17
#: A key-shaped token (so long, so many letters and digits) is a seed entity as well, but no base span.
KEY_LENGTH, KEY_LETTERS, KEY_DIGITS = 16, 3, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, at, end = [], text.find("@"), 0
    while at >= 0:
        s = at
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            found.append((s, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; offsets in code points."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(s, e, "email") for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def unseen(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit, clear of the base spans: what patterns may extract."""
    end, n = 0, len(text)
    spans = iter([*taken, (n + 1, n + 1, "")])
    s, e, _ = next(spans)
    for m in DIGIT.finditer(text):
        i = m.start()
        if i < end:
            continue
        while e <= i:
            s, e, _ = next(spans)
        if s <= i:
            end = e
            continue
        a, b = i, i + 1
        while a > end and (text[a - 1].isalnum() or text[a - 1] in "-_/"):
            a -= 1
        while b < min(n, s) and (text[b].isalnum() or text[b] in "-_/"):
            b += 1
        end = b
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if b - a >= SHORTEST:
            yield a, b


def key_shaped(token: str) -> bool:
    digits = sum(c.isdigit() for c in token)
    return len(token) >= KEY_LENGTH and digits >= KEY_DIGITS and sum(c.isalpha() for c in token) >= KEY_LETTERS


def joined(words: list[str], gap: str) -> list[str]:
    """Lexical patterns: the last one, two and three words before a place, and what stands between them and it."""
    gap = "".join(gap.split())
    return [f"{' '.join(words[-k:])}{gap}_" for k in range(1, len(words) + 1)] if len(gap) <= GAP else []


def patterns(text: str, start: int, end: int) -> list[str]:
    """The patterns before a span; leading signs of the span count as its gap."""
    left = list(WORD.finditer(text, max(0, start - CONTEXT), start))[-3:]
    first = WORD.search(text, start, end)
    if not left or not first:
        return []
    return joined([m[0].lower() for m in left], text[left[-1].end():first.start()])


_TEXT = "struct<base: array<struct<start: int, end: int, kind: string>>, sha: string, seen: array<struct<start: int, end: int, item: bigint, kind: string, patterns: array<string>>>>"


def _read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    empty = hashlib.sha256(b"").hexdigest()
    for texts in batches:
        base, sha, seen = [], [], []
        for t in texts:
            if not t or not MAYBE.search(t):
                base.append([])
                sha.append(empty)
                seen.append([])
                continue
            found = base_spans(t)
            occ = found + [(s, e, "key" if key_shaped(t[s:e]) else None) for s, e in unseen(t, found)]
            base.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
            sha.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in found).encode()).hexdigest())
            seen.append([{"start": s, "end": e, "item": xxhash.xxh64_intdigest(t[s:e].lower().encode("utf-8", "replace")) - (1 << 63), "kind": k, "patterns": patterns(t, s, e)} for s, e, k in occ])
        yield pd.DataFrame({"base": base, "sha": sha, "seen": seen})


def read(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, sha, seen), stored: base spans, and all spans that may be personal data with their patterns."""
    small_batches(docs.sparkSession)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.pandas_udf(_read, _TEXT)(F.col("text").cast("string")).alias("x"))
    return stash(d.select("row", "doc_id", "x.base", "x.sha", "x.seen"), "pii")


def marks(key: str, size: int) -> tuple[int, int]:
    """Two bits of a key in a filter of so many bits, a power of two."""
    h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "replace"))
    return h & (size - 1), h >> 32 & (size - 1)


def sieve(wanted: DataFrame, size: int) -> bytes:
    """A filter of so many bits that lets through all wanted patterns, their last words, and some others by chance.

    Tasks mark their patterns, and one adds up 16 filters: its size is fixed, so the driver's memory is.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            for p in b.column(0).to_pylist():
                bits[[*marks(p, size), *marks(f"\0{LAST.search(p)[0]}", size)]] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())], ["bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            for x in b.column(0).to_pylist():
                bits |= np.frombuffer(zlib.decompress(x), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    parts = wanted.select("pattern").repartition(16).mapInArrow(mark, "bits binary")
    return bytes(parts.coalesce(1).mapInArrow(merge, "bits binary").first()[0])


def background(docs: DataFrame, wanted: DataFrame, size: int = BITS) -> DataFrame:
    """(pattern, places): how often each wanted pattern stands before any word at all, over whole texts.

    One pass, whatever the number of patterns: a filter of fixed size goes to the texts, what it lets through is counted
    where it lies, and a join with the wanted patterns drops what came through by chance. A pattern is wanted only with
    its shorter ones, as whatever stands in it stands in them: a place whose shortest one isn't wanted has none.
    """
    wanted = stash(wanted.select("pattern").distinct(), "pii-wanted")
    cast = docs.sparkSession.sparkContext.broadcast(sieve(wanted, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = cast.value
        known: dict[str, bool] = {}
        n: Counter[str] = Counter()

        def there(key: str) -> bool:
            a, b = marks(key, size)
            return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["pattern", "places"])

        for b in batches:
            for t in b.column(0).to_pylist():
                two: list[str] = []
                end, last = -1, False
                for m in WORD.finditer(t or ""):
                    if last and m.start() - end <= CONTEXT and (found := joined(two, t[end:m.start()])):
                        some = known.get(found[0])
                        if some is None:
                            if len(known) >= HELD:
                                known.clear()
                            some = known[found[0]] = there(found[0])
                        if some:
                            n[found[0]] += 1
                            n.update(p for p in found[1:] if there(p))
                    w = m[0].lower()
                    last = known.get(w)
                    if last is None:
                        if len(known) >= HELD:
                            known.clear()
                        last = known[w] = there(f"\0{w}")
                    two = [*two[-2:], w]
                    end = m.end()
                if len(n) >= HELD:
                    yield counted()
                    n.clear()
        yield counted()

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern string, places long")
    return stash(found.groupBy("pattern").agg(F.sum("places").alias("places")).join(wanted, "pattern", "left_semi"), "pii-places")


def score_patterns(seen: DataFrame, places: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, supporters, trusted) from seen: (item, kind, pattern), as often as they come.

    Seeds are items that have a kind. A pattern's confidence for a kind is the worth of what stands in it, seeds and
    unseen items, over all the places where it stands before anything (places, and one more). So a word that stands
    before everything is worth nothing, whatever seeds follow it now and then. A trusted pattern has CONFIDENCE and
    SEEDS different items of worth PROMOTED behind it. An unseen item is worth the noisy-or of its trusted patterns; a
    found item so counts in the next round as a seed does, and may bring in patterns that no seed has. Items and patterns
    meet in aggregates and equi-joins on distinct edges, so a pattern with a third of all rows is summed where the rows lie.
    """
    edges = seen.groupBy("pattern", "item").agg(F.count("*").alias("n"))
    kinds = seen.where("kind is not null").groupBy("item").agg(F.min("kind").alias("known"))
    edges = stash(edges.join(kinds, "item", "left"), "pii-edges")
    known = edges.where("known is not null").select("pattern", "item", "n", F.col("known").alias("kind"), F.lit(1.0).alias("worth"))
    worth = known
    for i in range(rounds):
        pats = worth.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("worth")).alias("sum"), F.count_if(F.col("worth") >= PROMOTED).alias("supporters"))
        pats = pats.join(places, "pattern").withColumn("confidence", F.least(F.lit(1.0), F.col("sum") / (F.col("places") + 1)))
        pats = stash(pats.select("pattern", "kind", "confidence", "supporters", ((F.col("confidence") >= CONFIDENCE) & (F.col("supporters") >= SEEDS)).alias("trusted")), "pii-patterns")
        if i + 1 < rounds:
            items = edges.where("known is null").join(pats.where("trusted"), "pattern").groupBy("item", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("worth"))
            worth = known.unionByName(edges.where("known is null").join(items, "item").select("pattern", "item", "n", "kind", "worth"))
    return pats


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, base array<struct<start, end, kind>>, sha, extra (same type, kind id).

    Base spans stay as they are; extra ones don't overlap them. Null texts and texts without digits or @ have none.
    Unseen identifiers hold a digit and have SHORTEST characters or more. Key-shaped tokens are seeds and so induce
    patterns, but come out only where a trusted pattern stands before them. Repeated rows are read each; other columns are
    ignored. Empty table: no rows. Texts are read whole.
    """
    d = read(docs)
    seen = d.select("row", F.explode("seen").alias("s")).select("row", "s.start", "s.end", "s.item", "s.kind", F.explode("s.patterns").alias("pattern"))
    # what fewer items support is never trusted
    wanted = seen.groupBy("pattern").agg(F.count_distinct("item").alias("items")).where(F.col("items") >= SEEDS)
    places = background(docs, wanted)
    pats = score_patterns(seen.join(places, "pattern", "left_semi").select("item", "kind", "pattern"), places)
    good = pats.where("trusted").select("pattern").distinct()
    new = seen.where("kind is null or kind = 'key'").join(good, "pattern").groupBy("row").agg(F.collect_set(F.struct("start", "end", F.lit("id").alias("kind"))).alias("extra"))
    none = F.array().cast("array<struct<start: int, end: int, kind: string>>")
    return d.join(new, "row", "left").select("doc_id", "base", "sha", F.coalesce("extra", none).alias("extra"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find()."""
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.col("sha").alias("base_sha256"), spans_text(F.concat("base", "extra")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
