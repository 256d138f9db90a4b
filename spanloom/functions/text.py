"""Text kernel as column expressions: runs, match offsets, shingles, skeletons, validators. Offsets count code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALNUM, TOKEN = r"[\p{L}\p{N}]", r"[\p{L}\p{N}_]"
#: Words with inner hyphens or underscores, else one character that is no space.
WINDOW_TOKEN = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|\S"


def bind(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)  # noqa: PLW0108  a lambda of one argument


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def sums_before(sizes: pa.Array) -> pa.Array:
    """For each number of an array the sum of those before it."""
    offsets = sizes.offsets.to_numpy().astype(np.int64)
    flat = sizes.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].astype(np.int64)
    offsets = offsets - offsets[0]
    total = np.concatenate([[0], np.cumsum(flat)])
    own = total[:-1] - np.repeat(total[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own, pa.int32()))


def pieces(docs: DataFrame, pattern: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, pos, piece, start, hit): matches of pattern and what lies between, with offsets, worked out inside the row."""
    d = docs.repartition(*keys).select(*keys, F.regexp_extract_all("text", F.lit(f"({pattern})"), 1).alias("m"), F.split("text", pattern, -1).alias("g"))
    # gap 0, match 0, gap 1, ...
    d = d.select(*keys, F.flatten(F.transform("g", lambda x, i: F.when(i < F.size("m"), F.array(x, F.get("m", i))).otherwise(F.array(x)))).alias("p"))
    d = d.select(*keys, "p", sums_before(F.coalesce(F.transform("p", lambda x: F.length(x)), F.array().cast("array<int>"))).alias("start"))
    d = d.select(*keys, F.posexplode_outer(F.arrays_zip("p", "start")).alias("pos", "x"))
    return d.where("pos is not null").select(*keys, "pos", F.col("x.p").alias("piece"), F.col("x.start").alias("start"), (F.col("pos") % 2 == 1).alias("hit"))


def structs(*names: str, **more: T.DataType) -> T.ArrayType:
    """array<struct<..>> of whole numbers, and of more."""
    return T.ArrayType(T.StructType([T.StructField(n, k) for n, k in ({n: T.IntegerType() for n in names} | more).items()]))


@F.arrow_udf(structs("start", "end"))
def placed(sizes: pa.Array) -> pa.Array:
    """For each array of struct(g, m), lengths of a gap and of the match behind it, where the matches are; a last gap has none."""
    offsets = sizes.offsets.to_numpy().astype(np.int64)
    gap, match = sizes.values.slice(offsets[0], offsets[-1] - offsets[0]).flatten()
    offsets = offsets - offsets[0]
    hit = match.is_valid().to_numpy(zero_copy_only=False)
    m = match.fill_null(0).to_numpy().astype(np.int64)
    total = np.concatenate([[0], np.cumsum(gap.fill_null(0).to_numpy().astype(np.int64) + m)])
    end = (total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets)))[hit]
    of = np.concatenate([[0], np.cumsum(hit)])[offsets]
    at = pa.StructArray.from_arrays([pa.array(end - m[hit], pa.int32()), pa.array(end, pa.int32())], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), at)


@F.arrow_udf(T.ArrayType(T.StringType()))
def cuts(text: pa.Array, spans: pa.Array) -> pa.Array:
    """What stands in a text at each of an array of struct(start, end, ..).

    A text is decoded once; substring() walks from its beginning for each span, which a long text with many pays for.
    """
    at = spans.offsets.to_numpy().astype(np.int64)
    v = spans.values.slice(at[0], at[-1] - at[0])
    own = {f.name: c for f, c in zip(v.type, v.flatten(), strict=True)}
    start, end = (np.maximum(own[c].to_numpy(zero_copy_only=False).astype(np.int64), 0).tolist() for c in ("start", "end"))
    at = (at - at[0]).tolist()
    out = []
    for i, t in enumerate(text.to_pylist()):
        out += [None if t is None else t[a:b] for a, b in zip(start[at[i]:at[i + 1]], end[at[i]:at[i + 1]], strict=True)]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.string()))


#: Texts that wait for Python at once, at most.
ROWS = 256


def hits(docs: DataFrame, pattern: str, *columns: str, piece: bool = True) -> DataFrame:
    """docs' columns and m, an array of struct(start, end, piece): the matches of pattern, in order. A null text has null.

    Places are running sums of what lies between matches and of the matches, added up inside the row. Rows wait for them as
    texts, a few at once, and not as arrays of words, which take many times the text; without piece no array of words is
    made at all. Texts are dealt by the first column, but their matches are neither dealt nor sorted; a text stays one row
    until its caller takes them apart.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    found = F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)
    sizes = F.zip_with(F.split("text", pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    d = docs.repartition(columns[0]).select(*columns, F.col("text").alias("_t"), placed(sizes).alias("_w"))
    found = F.regexp_extract_all("_t", F.lit(f"({pattern})"), 1)
    m = F.zip_with("_w", found, lambda w, x: F.struct(w["start"].alias("start"), w["end"].alias("end"), x.alias("piece"))) if piece else F.when(F.col("_t").isNotNull(), F.col("_w"))
    return d.select(*columns, m.alias("m"))


def matches(docs: DataFrame, pattern: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, start, end, surface) of every match."""
    return hits(docs.where(F.col("text").rlike(pattern)), pattern, *keys).select(*keys, F.inline_outer("m")).where("start is not null").withColumnRenamed("piece", "surface")


def packed_runs(docs: DataFrame, *columns: str, piece: bool = True) -> DataFrame:
    """docs' columns and runs, an array of struct(start, end, piece): maximal runs of letters and numbers, in order."""
    return hits(docs, ALNUM + "+", *columns, piece=piece).withColumnRenamed("m", "runs")


def word_runs(docs: DataFrame, word: bool = True) -> DataFrame:
    """(doc_id, idx, start, end, word, next_end): maximal runs of letters and numbers, in order, with the end of the next."""
    # the outer form: a condition that Spark infers from the inner one would work out the array twice
    d = packed_runs(docs, "doc_id", piece=word).select("doc_id", F.posexplode_outer(F.arrays_zip("runs", F.slice(F.transform("runs", lambda r: r["end"]), F.lit(2), F.greatest(F.size("runs"), F.lit(0))).alias("next_end"))).alias("idx", "r"))
    return d.where("idx is not null").select("doc_id", F.col("idx").cast("long").alias("idx"), "r.runs.start", "r.runs.end", *([F.col("r.runs.piece").alias("word")] if word else []), "r.next_end")


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct n-word shingles of the lower-cased text; one of all words if fewer; none without words."""
    def made(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))))

    return bind(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN}+)"), 1), made)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty: 1."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def skeleton(text: Column, spans: Column) -> Column:
    """Text with spans (struct start, end, label) as <LABEL>, digits as 0, whitespace folded, lower case.

    Spans go by start, the longest first; those that begin inside one already replaced are skipped.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["label"].alias("label"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        grown = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["label"], F.lit(">")).alias("out"), (-s["neg"]).alias("at"))
        return F.when(s["start"] < acc["at"], acc).otherwise(grown)

    def close(acc: Column) -> Column:
        raw = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
        return F.lower(F.trim(F.regexp_replace(F.regexp_replace(raw, r"\p{Nd}", "0"), r"(?U)\s+", " ")))

    return F.aggregate(F.coalesce(order, F.array().cast("array<struct<start:int,neg:int,label:string>>")), start, step, close)


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digit_sum(digits: Column, weight) -> Column:
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + weight(F.coalesce(F.substring(digits, i, F.lit(1)).cast("int"), F.lit(0)), i, n))


def luhn_ok(digits: Column) -> Column:
    def weight(d: Column, i: Column, n: Column) -> Column:
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return _digit_sum(digits, weight) % 10 == 0


def aba_ok(digits: Column) -> Column:
    return (F.length(digits) == 9) & (_digit_sum(digits, lambda d, i, n: d * F.element_at(F.array(F.lit(3), F.lit(7), F.lit(1)), (i - 1) % 3 + 1)) % 10 == 0)


def iban_ok(iban: Column) -> Column:
    """Remainder 1 of the rearranged number by 97, folded character by character."""
    s = F.replace(iban, F.lit(" "), F.lit(""))

    def check(t: Column) -> Column:
        turned = F.concat(F.substring(t, 5, 64), F.substring(t, 1, 4))
        value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))
        return F.length(t).between(15, 34) & (rest == 1)

    return bind(s, check)


def reanchor(text: Column, start: Column, end: Column, surface: Column, window: int = 8) -> Column:
    """struct(start, end) of the surface's occurrence nearest to start within the window, null if none.

    A consistent or bare span stays. Of equally near ones the earlier wins; a surface with outer spaces is tried again
    without them.
    """
    lo, hi = F.greatest(start - window, F.lit(0)), F.least(end + window, F.length(text))

    def place(x: Column) -> Column:
        n = F.length(x)

        def nearest(near: Column) -> Column:  # the neighbourhood, so that long texts are cut once
            at = F.filter(F.when(hi - n >= lo, F.sequence(F.lit(0), F.greatest(hi - n - lo, F.lit(0)))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(near, i + 1, n) == x)
            best = F.array_min(F.transform(at, lambda i: F.struct(F.abs(lo + i - start).alias("d"), (lo + i).alias("i"))))
            return F.when(best.isNotNull() & (n > 0), F.struct(best["i"].alias("start"), (best["i"] + n).alias("end")))

        return bind(F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0))), nearest)

    same = F.struct(start.alias("start"), end.alias("end"))
    bare = F.trim(surface)
    return F.when(surface.isNull() | (F.substring(text, start + 1, end - start) == surface), same).otherwise(
        F.coalesce(place(surface), F.when((bare != "") & (bare != surface), F.when(F.substring(text, start + 1, end - start) == bare, same).otherwise(place(bare)))))


def neighbourhoods(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """spans (doc_id, start, end, s, e, ..) with surface, the text from start to end, and near, what lies within the window of
    s..e, from place `at` on: all that reanchor() reads. A text meets its spans in one row and is walked once."""
    rest = [c for c in spans.columns if c != "doc_id"]
    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*rest, F.greatest(F.col("s") - window, F.lit(0)).alias("at"))).alias("_own"))
    place = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    both = F.concat(F.transform("_own", lambda x: place(x["start"], x["end"])), F.transform("_own", lambda x: place(x["at"], x["e"] + window)))
    d = docs.select("doc_id", "text").join(own.hint("shuffle_hash"), "doc_id").withColumn("_cut", cuts("text", both))
    n = F.size("_own")
    d = d.select("doc_id", F.inline_outer(F.arrays_zip("_own", F.slice("_cut", F.lit(1), n).alias("surface"), F.slice("_cut", n + 1, n).alias("near")))).where("_own is not null")
    return d.select("doc_id", *[F.col(f"_own.{c}").alias(c) for c in (*rest, "at")], "surface", "near")


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) without outer whitespace."""
    s = F.substring(text, start + 1, end - start)
    left = F.length(s) - F.length(F.regexp_replace(s, r"(?U)^\s+", ""))
    right = F.length(s) - F.length(F.regexp_replace(s, r"(?U)\s+$", ""))
    return F.struct((start + left).alias("start"), F.greatest(end - right, start + left).alias("end"))


def surface_key(c: Column) -> Column:
    """Comparable without case or outer whitespace; sharp s folds to ss."""
    return F.replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit("ß"), F.lit("ss"))


def length_bucket(n: Column) -> Column:
    return F.when(n < 1000, "<1k").when(n < 10000, "1k-10k").otherwise(">10k")


def raw_label(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" "))


def label_text(name: Column, description: Column | None = None) -> Column:
    n = F.replace(name, F.lit("_"), F.lit(" "))
    return n if description is None else F.when(F.coalesce(description, F.lit("")) == "", n).otherwise(F.concat(n, F.lit(": "), description))


def spell(digits: Column, filler: str | None = None) -> Column:
    """Digits as words, a filler before every fourth."""
    names = F.array(*[F.lit(x) for x in ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")])
    each = F.transform(F.filter(F.split(digits, ""), lambda c: c.between("0", "9")), lambda c: F.get(names, c.cast("int")))
    if filler:
        each = F.transform(each, lambda w, i: F.when((i % 4 == 3), F.concat(F.lit(filler + " "), w)).otherwise(w))
    return F.array_join(each, " ")


def mentions(text: Column, name: Column, generic: tuple[str, ...] = ("number", "name", "id", "code")) -> Column:
    """Whether a word of the name, other than generic ones, is in the text."""
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({ALNUM}+)"), 1)
    return F.arrays_overlap(F.array_except(w(name), F.array(*[F.lit(x) for x in generic])), w(text))


def fits(text: Column, prompt: Column, n_labels: Column, limit: int) -> Column:
    """Whether the words of text and prompt and one a label stay within nine tenths of a model's limit."""
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(f"({WINDOW_TOKEN})"), 1))
    return count(text) + count(prompt) + n_labels <= F.floor(F.lit(0.9 * limit))
