"""SimHash near-duplicates: a binary-trie self-join over distinct fingerprints, then connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import components, fresh, small_batches
from spanloom.session import stash

BITS, BLOCK = 64, 16
#: Node pairs expanded at once, and links held before they are folded into a forest.
CHUNK, HELD = 1 << 19, 1 << 22
#: Distinct fingerprints that a first-level trie node may hold before it is split into node pairs of its children.
NODE_ROWS = 1 << 20


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 for a text without words."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    join, xxh = b" ".join, xxhash.xxh64_intdigest
    parts = [w] if len(w) < shingle else zip(*(w[k:] for k in range(shingle)), strict=False)
    ones, n, held = np.zeros(BITS, np.int64), 0, []
    for p in parts:
        held.append(xxh(join(p), seed))
        if len(held) == 65536:
            ones, n, held = ones + _ones(held), n + len(held), []
    if held:
        ones, n = ones + _ones(held), n + len(held)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _ones(hashes: list[int]) -> np.ndarray:
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, digest): one row per document; texts are read whole, null counts as empty; digest is the text's MD5."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, b.num_rows)
            sums = [hashlib.md5((t or "").encode("utf-8", "replace"), usedforsecurity=False).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(sums, pa.binary())], ["doc_id", "fp", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long, digest binary")


def _trie(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Path-compressed binary trie of sorted distinct values: left, right, depth and a value below each node, and the root.

    Leaves are nodes 0..m-1; a node's depth is the number of leading bits that everything below it shares.
    """
    m = len(f)
    left, right = np.full(2 * m - 1, -1, np.int64), np.full(2 * m - 1, -1, np.int64)
    depth, rep = np.full(2 * m - 1, BITS, np.int64), np.concatenate([f, np.zeros(m - 1, np.uint64)])
    x = f[1:] ^ f[:-1]
    lead = BITS - np.array([int(v).bit_length() for v in x], np.int64)
    spine: list[int] = [0]
    new = m
    for i, d in enumerate(lead.tolist()):
        last = -1
        while len(spine) > 1 and depth[spine[-2]] > d:
            last = spine.pop()
            right[spine[-1]] = last
        last = spine.pop()
        depth[new], left[new], rep[new] = d, last, f[i]
        spine += [new, i + 1]
        new += 1
    while len(spine) > 1:
        last = spine.pop()
        right[spine[-1]] = last
    return left, right, depth, rep, spine[0]


def _forest(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of m items: the smallest item that links reach."""
    lab = np.arange(m)
    while len(a):
        la, lb = lab[a], lab[b]
        go = la != lb
        a, b, la, lb = a[go], b[go], la[go], lb[go]
        if not len(a):
            break
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while (lab[lab] != lab).any():
            lab = lab[lab]
    return lab


def trie_links(f: np.ndarray, budget: int, exact_bits: int = 0, sides: tuple[int, int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Self-join of sorted distinct uint64 values within a Hamming budget, as forest edges (index, smaller index).

    Node pairs go down together. A pair is dropped once the bits in which the two prefixes differ exceed the budget, or
    once they differ within the first exact_bits. With sides (depth, pa, pb) only pairs of one value under prefix pa and
    one under pb count. Long frontiers are cut into chunks, deepest first, and links are folded into a forest when many.
    """
    m = len(f)
    if m < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right, depth, rep, root = _trie(f)

    def across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not sides:
            return np.ones(len(a), bool)
        cut, pa_, pb_ = np.uint64(BITS - sides[0]), *(np.uint64(x % (1 << BITS)) for x in sides[1:])
        p, q = f[a] >> cut, f[b] >> cut
        return ((p == pa_) & (q == pb_)) | ((p == pb_) & (q == pa_))

    ends: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(np.array([root]), np.array([root]))]
    while stack:
        a, b = stack.pop()
        if len(a) > CHUNK:
            stack.append((a[CHUNK:], b[CHUNK:]))
            a, b = a[:CHUNK], b[:CHUNK]
        own = a == b
        s = a[own]
        s = s[depth[s] < BITS]
        go = [(left[s], left[s]), (right[s], right[s]), (left[s], right[s])]
        a, b = a[~own], b[~own]
        if len(a):
            swap = depth[a] > depth[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)  # a is the shallower of the two
            go += [(left[a], b), (right[a], b)]
        a, b = (np.concatenate(x) for x in zip(*go, strict=True))
        own = a == b
        keep = [(a[own], b[own])]
        a, b = a[~own], b[~own]
        if len(a):
            x, d = rep[a] ^ rep[b], np.minimum(depth[a], depth[b])
            x = np.where(d == 0, np.uint64(0), x >> (BITS - np.maximum(d, 1)).astype(np.uint64)) << (BITS - np.maximum(d, 1)).astype(np.uint64)
            ok = np.bitwise_count(x) <= budget
            if exact_bits:
                ok &= (x >> np.uint64(BITS - exact_bits)) == 0
            a, b = a[ok], b[ok]
            done = (depth[a] == BITS) & (depth[b] == BITS)
            if done.any():
                # a forest stands for its links only if all of them count
                counts = across(a[done], b[done])
                ends.append((a[done][counts], b[done][counts]))
                held += int(counts.sum())
                if held > HELD:
                    lab = _forest(m, *(np.concatenate(x) for x in zip(*ends, strict=True)))
                    i = np.flatnonzero(lab != np.arange(m))
                    ends, held = [(i, lab[i])], len(i)
            keep.append((a[~done], b[~done]))
        a, b = (np.concatenate(x) for x in zip(*keep, strict=True))
        if len(a):
            stack.append((a, b))
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    lab = _forest(m, a, b)
    i = np.flatnonzero(lab != np.arange(m))
    return i, lab[i]


def links(nodes: DataFrame, budget: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) that span the groups of distinct fingerprints within the Hamming budget. nodes: (id, fp), fp unique.

    Two fingerprints within 3 bits agree on one of four 16-bit blocks. Each rotation brings one block to the top of the
    trie, where the budget is 0; below it is the full budget. Trie nodes at that depth are the unit of distribution. A
    node with more than node_rows fingerprints, about as many as a task holds, is replaced by the pairs of its
    descendants 8 levels further down whose prefixes are within the budget, again and again; as fingerprints are
    distinct this ends.
    """
    assert budget < BITS // BLOCK, "one block must stay exact"
    spark = nodes.sparkSession

    def turned(r: int):
        return F.col("fp") if r == 0 else F.shiftleft("fp", BLOCK * r).bitwiseOR(F.shiftrightunsigned("fp", BITS - BLOCK * r))

    rows = nodes.select("id", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), turned(r).alias("v")) for r in range(BITS // BLOCK)])).alias("x"))
    key = ["r", "depth", "pa", "pb"]
    tasks = rows.select("id", "x.r", "x.v", F.lit(BLOCK).alias("depth"), F.shiftrightunsigned("x.v", BITS - BLOCK).alias("pa")).withColumn("pb", F.col("pa"))
    done = []
    while True:
        sizes = tasks.groupBy(*key).count().where(F.col("count") > node_rows).select(*key)
        if sizes.isEmpty():
            break
        sizes = stash(sizes, "wide-nodes")
        done.append(tasks.join(sizes, key, "left_anti"))
        wide = tasks.join(sizes, key)
        mine = F.expr(f"shiftrightunsigned(v, {BITS} - depth - 8)")
        wide = wide.withColumn("mine", mine).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(255))))
        other = F.when(F.shiftrightunsigned("mine", 8) == F.col("pa"), F.col("pb")).otherwise(F.col("pa"))
        wide = wide.withColumn("theirs", F.shiftleft(other, 8).bitwiseOR(F.col("q").cast("long")))
        wide = wide.where(F.bit_count(F.col("mine").bitwiseXOR(F.col("theirs"))) <= budget)
        tasks = stash(wide.select("id", "r", "v", (F.col("depth") + 8).alias("depth"), F.least("mine", "theirs").alias("pa"), F.greatest("mine", "theirs").alias("pb")), "node-pairs")
    for part in done:
        tasks = tasks.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        c = {n: t.column(n).to_numpy() for n in t.column_names}
        # nodes of one rotation that were not split share a trie: its first levels have no budget
        plain = (c["pa"] == c["pb"]) & (c["depth"] == BLOCK)
        _, group = np.unique(np.stack([np.where(plain, -1, c["depth"]), c["r"], np.where(plain, 0, c["pa"]), np.where(plain, 0, c["pb"])]), axis=1, return_inverse=True)
        order = np.argsort(group, kind="stable")
        for one in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            f, first = np.unique(c["v"][one].view(np.uint64), return_index=True)
            k = one[first]
            sides = None if plain[k[0]] else (int(c["depth"][k[0]]), int(c["pa"][k[0]]), int(c["pb"][k[0]]))
            i, j = trie_links(f, budget, BLOCK, sides)
            if len(i):
                ids = c["id"][k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * (BITS // BLOCK) // node_rows), 1)
    return tasks.select("id", "r", "v", "depth", "pa", "pb").repartition(n, *key).mapInArrow(run, "a long, b long")


def clusters(fps: DataFrame, budget: int = 3) -> DataFrame:
    """(fp, cluster, component_id): distinct fingerprints with their component and the least doc_id of its rows."""
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comp = components(links(nodes.select(F.col("fp").alias("id"), "fp"), budget)).withColumnRenamed("id", "fp")
    named = stash(nodes.join(comp, "fp", "left").select("fp", F.coalesce("component", "fp").alias("cluster"), "first"), "clusters")
    return named.join(named.groupBy("cluster").agg(F.min("first").alias("component_id")), "cluster").select("fp", "cluster", "component_id")


def near_duplicates(docs: DataFrame, budget: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Nodes are the distinct fingerprints, so copies of any number cost one row, and components are sets of fingerprints:
    rows belong together by their texts alone. Two rows of one doc_id are two rows; they share a component only if their
    texts do. component_id is the least doc_id among a component's rows, null if none has an id. Null texts and texts
    without words have fingerprint 0 and link like any other. Repeated rows are returned as often as they come; other
    columns are ignored. Empty table: no rows.
    """
    fps = stash(fingerprints(docs, shingle).drop("digest"), "fingerprints")
    return fps.join(clusters(fps, budget), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: the first by doc_id (rows without one come last), then by the text's MD5.

    Rows are told apart by doc_id and text, so a doc_id that repeats with another text loses nothing that isn't kept in
    some near-duplicate; of rows alike in both one stays. Null, empty and wordless texts are one group. Empty table: no rows.
    """
    fps = stash(fingerprints(docs), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    rows = fps.join(clusters(fps), "fp").select("cluster", row.alias("row"))
    first = rows.groupBy("cluster").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = stash(rows.join(first, "cluster").select("row", (F.col("row") == F.col("first")).alias("stays")), "copies")
    gone = rows.where("not stays").select("row.doc_id", "row.digest").distinct()
    twice = stash(rows.where("stays").groupBy("row").count().where("count > 1").select("row.doc_id", "row.digest"), "repeated")
    digest = fresh(docs, "digest")
    d = docs.withColumn(digest, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))

    def same(keys: DataFrame):
        return F.col("doc_id").cast("long").eqNullSafe(keys["of_id"]) & (F.col(digest) == keys["of_digest"])

    gone, twice = (k.toDF("of_id", "of_digest") for k in (gone, twice))
    d = d.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():
        d = d.join(twice, same(twice), "left_anti").unionByName(d.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", digest]))
    return d.select(*docs.columns)
