"""Structured detectors with exact offsets, and copying confident mentions within a document."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import aba_ok, cuts, digits_of, iban_ok, luhn_ok, matches
from spanloom.operators import numbering
from spanloom.operators.spans import as_b, overlap_join, suppress

# Detector patterns. Telephone numbers go by a numbering plan (numbering.py).
PATTERNS = {
    "card": r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])",
    "iban": r"(?<![\p{L}\p{N}_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}_])",
    "ssn": r"(?<![0-9])(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])",
    "email": r"(?<![\p{L}\p{N}_])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\p{L}\p{N}_])",
    "aba": r"(?<![0-9])[0-9]{9}(?![0-9])",
}
LABELS = {"card": "ACCOUNT_NUMBER", "iban": "ACCOUNT_NUMBER", "ssn": "ACCOUNT_NUMBER", "email": "EMAIL", "aba": "ACCOUNT_NUMBER", "phone": "PHONE"}


def validated(docs: DataFrame, kind: str) -> DataFrame:
    """(doc_id, start, end, surface) of one kind that pass its checks."""
    if kind == "phone":
        return numbering.phones(docs)
    m = matches(docs, PATTERNS[kind])
    if kind == "card":
        d = digits_of(F.col("surface"))
        return m.where(F.length(d).between(13, 19) & luhn_ok(d))
    if kind == "iban":
        return m.where(iban_ok(F.col("surface")))
    if kind == "aba":
        near = m.where(aba_ok(F.col("surface"))).join(docs.select("doc_id", "text"), "doc_id")
        cue = F.lower(F.expr("substring(text, greatest(start - 40, 0) + 1, least(start, 40))")).rlike("routing|aba|transit")
        return near.where(cue).select("doc_id", "start", "end", "surface")
    return m


def validator_spans(docs: DataFrame, kinds: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    """(doc_id, start, end, label, raw, score, surface), score 1."""
    out = None
    for k in kinds:
        d = validated(docs, k).select("doc_id", "start", "end", F.lit(LABELS[k]).alias("label"), F.lit(k).alias("raw"), F.lit(1.0).alias("score"), "surface")
        out = d if out is None else out.unionByName(d)
    return out


#: Titles before a name, and characters that one may stand before it at most, spaces included.
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam")
TITLE_REACH = 8


WORD = re.compile(r"\w+")


def found(text: str, surfaces: list[str]) -> list[tuple[int, int, int]]:
    """(surface, start, end) of the whole-word places of surfaces in a text, by one walk over its words.

    A surface's first word is a whole word of the text at each place, so it is looked up only where that word is. Places of
    one surface don't overlap. Surfaces hold a letter or digit.
    """
    by: dict[str, list[list]] = {}
    for k, s in enumerate(surfaces):
        if m := WORD.search(s):
            by.setdefault(m.group(), []).append([k, s, m.start(), 0])
    out = []
    for m in WORD.finditer(text) if by else ():
        for x in by.get(m.group(), ()):
            k, s, ahead, free = x
            a = m.start() - ahead
            b = a + len(s)
            if a >= free and text.startswith(s, a) and (b == len(text) or not WORD.match(text, b)) and (a == 0 or not WORD.match(text, a - 1)):
                out.append((k, a, b))
                x[3] = b
    return out


def places(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """surfaces (doc_id, surface, ..) with start, end and before of each whole-word place of the surface in its text.

    A text meets all of its surfaces in one row and is read once; before is what stands TITLE_REACH characters ahead of a
    place.
    """
    rest = [c for c in surfaces.columns if c != "doc_id"]
    own = surfaces.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("_own"))

    @F.arrow_udf("array<struct<k:int,start:int,end:int,before:string>>")
    def look(text: pa.Array, names: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("k", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.string())]))
        each = ((t.as_py(), n.as_py()) for t, n in zip(text, names, strict=True))
        return pa.array([[(k, a, b, t[max(0, a - TITLE_REACH):a]) for k, a, b in found(t, n)] if t is not None else [] for t, n in each], kind)

    d = docs.select("doc_id", "text").join(own, "doc_id").withColumn("_at", look("text", F.transform("_own", lambda x: x["surface"])))
    d = d.select("doc_id", "_own", F.inline("_at")).withColumn("_x", F.get("_own", "k"))
    return d.select("doc_id", *[F.col(f"_x.{c}").alias(c) for c in rest], "start", "end", "before")


def propagate(docs: DataFrame, preds: DataFrame, least: float = 0.5, letters: int = 4) -> DataFrame:
    """(doc_id, start, end, label, score, propagated): preds and their copies.

    A confident prediction is copied to the other whole-word places of its surface: a surface needs so many letters or
    digits, a person a capital first and either several words or a title before the place. What a prediction covers stays
    free of copies; of copies that overlap the better scored stays, of equals the one whose prediction comes first. Copies
    are ranked in their document, and suppression by rank settles overlaps group by group.
    """
    p = preds.select("doc_id", "start", "end", "label", "score")
    own = p.where(F.col("score") >= least).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "score")).alias("_own"))
    sure = docs.select("doc_id", "text").join(own.hint("shuffle_hash"), "doc_id").withColumn("_cut", cuts("text", "_own"))  # a text is walked once
    sure = sure.select("doc_id", F.inline_outer(F.arrays_zip("_own", F.col("_cut").alias("surface")))).where("_own is not null")
    sure = sure.select("doc_id", "_own.label", "_own.score", F.col("_own.start").alias("from"), F.col("_own.end").alias("to"), "surface")
    person = F.col("label") == "PERSON"
    sure = sure.where(F.length(F.regexp_replace("surface", r"[^\p{L}\p{N}]", "")) >= letters).where(~person | F.col("surface").rlike(r"^\p{Lu}"))
    rank = F.struct((-F.col("score")).alias("s"), "from", "to", "label")
    best = sure.groupBy("doc_id", "surface", "label").agg(F.min(rank).alias("rank"))
    titled = F.lower("before").rlike(rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(HONORIFICS)})\.?\s+$")
    named = ~person | F.trim("surface").contains(" ") | titled
    new = places(docs, best).where(named).groupBy("doc_id", "start", "end").agg(F.min("rank").alias("rank"))
    new = overlap_join(new, as_b(p), how="left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "start"))
    new = new.select("doc_id", "start", "end", F.col("rank.label").alias("label"), (-F.col("rank.s")).alias("own"), (-place).cast("double").alias("score"))
    stay = suppress(new).select("doc_id", "start", "end")
    new = new.join(stay, ["doc_id", "start", "end"]).select("doc_id", "start", "end", "label", F.col("own").alias("score"), F.lit(True).alias("propagated"))
    return p.withColumn("propagated", F.lit(False)).unionByName(new)
