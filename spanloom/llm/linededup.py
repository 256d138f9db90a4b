"""Line deduplication: exact classes, then a segment-partition edit join between different lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACES, components, fresh, let, small_batches
from spanloom.session import stash

#: Edits allowed at most, characters of a line for each edit it may have, and shortest line that takes part: blank ones don't.
MAX_EDITS, CHARS_PER_EDIT, MIN_CHARS = 2, 20, 1
#: Rows up to which a table of keys or line ids is broadcast (8 to 16 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows of a key beyond which its lines meet by spread(), characters of a cell there, and hashes that a task remembers.
GROUP_ROWS, CELL, SEEN = 32, 16, 1_000_000


def budget(length: int) -> int:
    return min(MAX_EDITS, length // CHARS_PER_EDIT)


def fails_at(a: str, b: str, k: int) -> int | None:
    """None if the edit distance of a and b is at most k; else how many characters of a rule that out for every beginning of b.

    Bit-parallel columns of a band of 2k + 1 diagonals: bit i of the vectors stands for diagonal i - k of the current
    row, so words stay 2k + 1 bits wide however long the lines are. reach[e] holds the diagonals within e edits.
    len(a) + 1 stands for a mismatch that only the end shows.
    """
    lead, n = 0, min(len(a), len(b))
    while lead < n and a[lead] == b[lead]:
        lead += 1
    width, m, n = 2 * k + 1, len(a) - lead, len(b) - lead
    full = (1 << width) - 1
    reach = [1 << k]
    for _ in range(k):
        reach.append((reach[-1] | reach[-1] << 1) & full)  # leading characters of b only
    for j in range(m):
        c, same = a[lead + j], 0
        for i in range(max(0, k - j), min(width, n - j + k)):
            if b[lead + j + i - k] == c:
                same |= 1 << i
        now: list[int] = []
        for e, r in enumerate(reach):
            x = r & same
            if e:
                prev = reach[e - 1]
                x |= prev | prev >> 1 | now[e - 1] << 1  # replace; a character of a only; one of b only
            now.append(x & full)
        reach = now
        if not reach[-1]:
            return lead + j + 1
    last = n - m + k
    return None if 0 <= last < width and reach[-1] >> last & 1 else len(a) + 1


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of a and b is at most k."""
    return abs(len(a) - len(b)) <= k and fails_at(a, b, k) is None


def fold(line: bytes) -> str:
    """A line with runs of ASCII whitespace folded to a space."""
    return b" ".join(line.split()).decode("utf-8", "replace")


def line_hash(norm: str) -> int:
    return xxhash.xxh64_intdigest(norm.encode("utf-8", "replace")) - (1 << 63)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def windows(size: int) -> list[tuple[int, int, int]]:
    """(seed, from, to) of the substrings under which a line of this size meets every other within its budget.

    For each length s that a partner at most as long may have, that partner is cut into budget(s) + 1 segments; of these
    one at least is untouched, and starts in the longer line within a window that the edits left and right of it allow.
    The seed stands for (s, segment). The line's own segments are those for s = its length, without a shift.
    """
    out = []
    for delta in range(MAX_EDITS + 1):
        short = size - delta
        tau = budget(short)
        if not tau or delta > tau:
            continue
        base, extra = divmod(short, tau + 1)
        for i in range(tau + 1):
            first = base * i + max(0, extra - (tau + 1 - i))  # the last `extra` segments are one longer
            length = base + (tau + 1 - i <= extra)
            for p in range(max(-i, delta - (tau - i)), min(i, delta + tau - i) + 1):
                out.append((short * 8 + i, first + p, first + p + length))
    return out


def keys(norm: str, at: dict[int, list[tuple[int, int, int]]]) -> list[int]:
    size = len(norm)
    w = at.get(size)
    if w is None:
        w = at[size] = windows(size)
    return [xxhash.xxh64_intdigest(norm[a:b].encode("utf-8", "replace"), s) - (1 << 63) for s, a, b in w]


def read(docs: DataFrame) -> DataFrame:
    """(doc_id, t, line, h, keys) of every line of whole texts that takes part, stored; keys once a task for equal lines.

    t is Spark's xxhash64 of the text: with doc_id it tells rows apart.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sizes: dict[int, list[tuple[int, int, int]]] = {}
        for b in batches:
            ids, whole, where, hashes, found = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                encoded = t.encode("utf-8", "replace")
                own = signed(xxhash.xxh64_intdigest(encoded, 42))
                for k, raw in enumerate(encoded.split(b"\n")):
                    if len(raw) < MIN_CHARS or len(norm := fold(raw)) < MIN_CHARS:
                        continue
                    h = line_hash(norm)
                    ids.append(i)
                    whole.append(own)
                    where.append(k)
                    hashes.append(h)
                    found.append([] if h in seen else keys(norm, sizes))
                    seen.add(h)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(whole, pa.int64()), pa.array(where, pa.int32()), pa.array(hashes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "t", "line", "h", "keys"])

    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stash(d.mapInArrow(run, "doc_id long, t long, line int, h long, keys array<long>"), "lines")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def texts_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(h, norm) for places (doc_id, t, line, h); only texts of their documents are opened."""
    want = _few(stash(places.groupBy("doc_id", "t").agg(F.collect_list(F.struct("line", "h")).alias("want")), "line-wants"))
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("x")).select("doc_id", F.xxhash64("x").alias("t"), F.split("x", "\n").alias("parts")).join(want, ["doc_id", "t"])
    d = d.select("parts", F.explode("want").alias("x")).select("x.h", F.get("parts", F.col("x.line")).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm = [fold((r or "").encode("utf-8", "replace")) for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(norm, pa.string())], ["h", "norm"])

    return stash(d.mapInArrow(run, "h long, norm string").dropDuplicates(["h"]), "line-texts")


def spread(met: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) to the pivots of large groups, and the other pairs (a, b) to verify, far fewer than all that share a
    key. met: (key, h, n); n: how often a line comes.

    Lines within their budget of the pivot are linked to it, and pairs of two such lines are left out: they are in one
    class already.

    The group's pivot is its most frequent line; groups with one pivot are treated as one. A line x that leaves the pivot after l characters, and whose first r
    characters rule out k edits against every beginning of the pivot, is within k edits of y only if y, which leaves the
    pivot no earlier, does so after r + k characters at most: else all that x could be matched with is the pivot's. So x
    waits in the cells from l to r + k and y looks in the cell of its own departure. A line near the whole pivot waits to
    its end. The same holds read from the end, which is checked as pairs meet.
    """
    pivot = met.groupBy("key").agg(F.max_by("h", F.struct("n", "h")).alias("p"))
    rows = met.join(pivot, "key").select("p", "h").distinct().join(texts, "h").join(texts.select(F.col("h").alias("p"), F.col("norm").alias("pivot")), "p").select("p", "h", "norm", "pivot")

    def stay(x: str, p: str) -> tuple[int, int]:
        lead, n = 0, min(len(x), len(p))
        while lead < n and x[lead] == p[lead]:
            lead += 1
        r = fails_at(x, p, MAX_EDITS)
        return lead, (max(len(x), len(p)) if r is None or r > len(x) else r) + MAX_EDITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            got = [(*stay(x, p), *stay(x[::-1], p[::-1])) for x, p in both]
            near = pa.array([within(x, p, budget(min(len(x), len(p)))) for x, p in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), near, *(pa.array([g[i] for g in got], pa.int32()) for i in range(4))], ["p", "h", "near", "l", "r", "back_l", "back_r"])

    cells = stash(rows.mapInArrow(run, "p long, h long, near boolean, l int, r int, back_l int, back_r int"), "line-cells")
    star = cells.where("near and h <> p").select(F.least("h", "p").alias("a"), F.greatest("h", "p").alias("b"))
    x = cells.select("p", F.col("h").alias("a"), "near", "l", "r", "back_l", "back_r", F.explode(F.sequence(F.expr(f"l div {CELL}"), F.expr(f"r div {CELL}"))).alias("cell"))
    y = cells.select("p", F.col("h").alias("b"), F.col("near").alias("near_b"), F.col("l").alias("m"), F.col("back_l").alias("back_m"), F.col("back_r").alias("back_s"), F.expr(f"l div {CELL}").alias("cell"))
    ahead = F.col("m").between(F.col("l"), F.col("r"))
    behind = F.col("back_m").between(F.col("back_l"), F.col("back_r")) | F.col("back_l").between(F.col("back_m"), F.col("back_s"))
    apart = ~(F.col("near") & F.col("near_b"))
    both = x.join(y, ["p", "cell"]).where(apart & (F.col("a") != F.col("b")) & ((F.col("l") < F.col("m")) | (F.col("a") < F.col("b"))) & ahead & behind)
    return star, both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar(docs: DataFrame, lines: DataFrame, places: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between different lines within their edit budget, enough for their classes: lines near a group's pivot
    are linked to it alone. places: (h, doc_id, t, line, n), one for each h.

    1. Keys that more than one line has: per key the least and greatest line hash and the number of rows, pre-aggregated
       on the map side, so copies of a line cost nothing. 2. Only lines under such keys meet, key by key; in groups of
       more than group_rows only those that spread() can't rule out. 3. Pairs are verified by edit distance. The budget
       of a pair is that of its shorter line.
    """
    keyed = lines.select("h", F.explode("keys").alias("key"))
    shared = stash(keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("key", "rows"), "line-keys")
    met = stash(keyed.join(_few(shared), "key").select("key", "h", (F.col("rows") > group_rows).alias("large")).distinct(), "line-meetings")
    ids = stash(met.select("h").distinct().join(places, "h").select("doc_id", "t", "line", "h", "n"), "line-ids")
    texts = texts_of(docs, ids)
    few = met.where("not large").select("key", "h")
    pairs = few.select("key", F.col("h").alias("a")).join(few.select("key", F.col("h").alias("b")), "key").where("a < b").select("a", "b")
    star, others = spread(met.where("large").select("key", "h").join(ids.select("h", "n"), "h"), texts)
    pairs = stash(pairs.unionByName(others).distinct(), "line-pairs")
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("norm").alias("ta")), "a").join(texts.select(F.col("h").alias("b"), F.col("norm").alias("tb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, tb = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = pa.array([within(x, y, budget(min(len(x), len(y)))) for x, y in zip(ta, tb, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(ok)

    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long").unionByName(star)


def line_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, class_doc_id, class_line, n_lines, removed) for every line whose class has two lines or more.

    A class is what exact copies and links within the edit budget reach. Its first line, by (doc_id, text_hash, line),
    stays; the others are removed. Lines are compared with whitespace folded. Blank ones never take part; those under
    CHARS_PER_EDIT characters have no edits and count as copies only if equal.
    Line numbers count from 0. Null texts have no lines; rows without doc_id neither remove nor lose lines. Rows of one
    doc_id with different texts are different rows, told apart by text_hash (Spark's xxhash64 of the text); rows equal in
    both are one, as one can't be told from the other. Other columns are ignored. Empty table: no rows.
    """
    rows = read(docs)
    at = stash(rows.select("doc_id", "t", "line", "h").distinct(), "line-places")
    exact = stash(at.groupBy("h").agg(F.min(F.struct("doc_id", "t", "line")).alias("first"), F.count("*").alias("n")), "line-firsts")
    comp = components(similar(docs, rows, exact.select("h", "first.doc_id", "first.t", "first.line", "n")))
    # the line that gave a class its name is in it as well
    names = comp.unionByName(comp.select(F.col("component").alias("id"), "component")).distinct().withColumnRenamed("id", "h")
    c = exact.join(names, "h", "left").where("n > 1 or component is not null")
    c = stash(c.select("h", F.coalesce("component", "h").alias("class"), "first", "n"), "line-classes")
    named = c.groupBy("class").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    c = stash(c.select("h", "class").join(named, "class").select("h", "first", "n"), "line-classes")
    found = at.join(c, "h")
    removed = F.struct("doc_id", "t", "line") != F.col("first")
    return found.select("doc_id", F.col("t").alias("text_hash"), "line", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line").alias("class_line"), F.col("n").alias("n_lines"), removed.alias("removed"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs without the removed lines, n_chars (if there) renewed; a row that loses every line with a word goes.

    Rows that lose nothing pass through unchanged: texts without words, null texts and rows without doc_id among them. A
    repeated doc_id with another text is a row of its own; rows equal in doc_id and text lose the same lines. All
    columns stay, whatever their names.
    """
    t, gone = fresh(docs, "t"), fresh(docs, "gone")
    lost = stash(line_classes(docs).where("removed").select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_t"), "line"), "removed-lines")
    by_row = lost.groupBy("of_id", "of_t").agg(F.collect_set("line").alias(gone))
    d = docs.withColumn(t, F.xxhash64(F.col("text").cast("string")))
    by_row = F.broadcast(by_row) if lost.count() <= BROADCAST_ROWS else by_row
    d = d.join(by_row, (d["doc_id"].cast("long") == by_row["of_id"]) & (d[t] == by_row["of_t"]), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))  # by hash: linear in the lines
    kept = let(lines, lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n"))
    whole = F.col(gone).isNull()
    d = d.withColumn("text", F.when(whole, F.col("text")).otherwise(kept)).where(whole | (F.length(F.translate("text", SPACES, "")) > 0))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)
