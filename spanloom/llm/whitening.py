"""Embedding whitening from an exact integer scatter: nothing is rounded before the covariance is formed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import small_batches
from spanloom.session import stash

#: x = floor(SCALE * c) + OFFSET for an entry c.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Numbers are cut into limbs of so many bits; products of two limbs over so many rows stay whole in a double.
LIMB, LIMB_ROWS = 16, 1 << 20
#: Partial results that one task adds up.
FAN_IN = 64


@dataclass(frozen=True)
class Fit:
    """Whitening of vectors of one length: n, exact sums S, trace of the covariance, eigenvalues falling, vectors as columns."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    axes: np.ndarray


def valid(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, c array<double>): rows without null vectors and null or non-finite entries."""
    c = F.col(column).cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(key), c.alias("c")).where(F.col("c").isNotNull() & ~bad)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each length of a batch of vectors."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[starts[at][:, None] + np.arange(d)[None, :]]


def whole(c: np.ndarray) -> np.ndarray:
    """x less the offset, as int64, or as Python's whole numbers where an entry is beyond 2^62."""
    f = np.floor(c * SCALE) if np.abs(c).max(initial=0.0) < 2.0**1000 else np.floor(c.astype(np.longdouble) * SCALE)
    if np.abs(f).max(initial=0.0) < 2.0**62:
        return f.astype(np.int64)
    return np.array([[int(v) for v in row] for row in f], dtype=object).reshape(f.shape)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as sum of limb k times 2^(LIMB k), as doubles; the last limb carries the sign."""
    out = []
    while True:
        most = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0)
        if most < 1 << LIMB:
            return [*out, x.astype(float)]
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB


def scatter(x: np.ndarray) -> np.ndarray:
    """Exact (rows, 1 + d) sums of a block of whole numbers: XᵀX with the sums of X in column 0, as Python's whole numbers.

    Each pair of limbs is one product of double matrices whose sums stay below 2^53.
    """
    d = x.shape[1]
    total = np.zeros((d, d + 1), dtype=object)
    for lo in range(0, len(x), LIMB_ROWS):
        parts = limbs(x[lo:lo + LIMB_ROWS])
        for i, a in enumerate(parts):
            total[:, 0] += a.sum(0).astype(np.int64).astype(object) << (LIMB * i)
            for j, b in enumerate(parts):
                total[:, 1:] += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def packed(row: np.ndarray) -> list[str]:
    return [format(int(v), "x") for v in row]


def tree(partial: DataFrame, add: Callable[[pd.DataFrame], dict], what: str) -> DataFrame:
    """Adds up partial rows (d, i, n, part, ...) by (d, i), FAN_IN of them at a time, in as many rounds as it takes.

    So no task reads more than that, whatever the number of vectors; rounds are stored, so a lost executor costs its tasks.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in partial.schema)

    def of_group(t: pd.DataFrame) -> pd.DataFrame:
        first = t.sort_values("part")
        return pd.DataFrame([{"d": t["d"].iloc[0], "i": t["i"].iloc[0], "n": t["n"].sum(), "part": t["part"].iloc[0] // FAN_IN} | add(first)])

    while True:
        partial = stash(partial, what)
        last = partial.agg(F.max("part")).first()[0] or 0
        partial = partial.groupBy("d", "i", F.expr(f"part div {FAN_IN}").alias("to")).applyInPandas(of_group, schema)
        if last < FAN_IN:
            return partial


def exact_sums(vectors: DataFrame) -> DataFrame:
    """(d, i, n, part, v) of valid vectors: row i of the sums over all of length d, as whole numbers in hexadecimal."""
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, c in by_length(b.column(0)):
                d = c.shape[1]
                n[d] = n.get(d, 0) + len(at)
                s = scatter(whole(c))
                sums[d] = sums[d] + s if d in sums else s
        part = TaskContext.get().partitionId()
        for d, s in sums.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * d, "i": list(range(d)), "n": [n[d]] * d, "part": [part] * d, "v": [packed(r) for r in s]}, schema=schema)

    def add(t: pd.DataFrame) -> dict:
        v = [int(x, 16) for x in t["v"].iloc[0]]
        for row in t["v"].iloc[1:]:
            v = [a + int(x, 16) for a, x in zip(v, row, strict=True)]
        return {"v": packed(v)}

    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("part", pa.int32()), ("v", pa.list_(pa.string()))])
    return tree(vectors.select("c").mapInArrow(of_task, "d int, i int, n long, part int, v array<string>"), add, "scatter")


def solve(n: int, rows: list[list[int]], components: int) -> Fit:
    """Whitening from the exact sums: n XᵀX - SSᵀ in whole numbers, divided by n² only then, decomposed by eigh."""
    d = len(rows)
    sums = [r[0] for r in rows]
    v = np.array([[(n * rows[i][1 + j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    some = int((e > e[0] * d * np.finfo(float).eps).sum()) if d and e[0] > 0 else 0
    k = min(components, some)
    return Fit(n, tuple(sums), float(np.trace(v)), e[:k].copy(), q[:, :k].copy())


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A Fit for each length of valid vectors; d rows of sums of a length come to the driver, however many vectors there are."""
    rows: dict[int, dict[int, list[int]]] = {}
    n: dict[int, int] = {}
    for r in exact_sums(vectors).toLocalIterator():
        n[r.d] = r.n
        rows.setdefault(r.d, {})[r.i] = [int(x, 16) for x in r.v]
    return {d: solve(n[d], [rows[d][i] for i in range(d)], components) for d in sorted(rows)}


def centred(x: np.ndarray, f: Fit) -> np.ndarray:
    """n x - S, exact: int64 where all fits, else Python's whole numbers."""
    most = max([1, *(abs(s) for s in f.sums)])
    if x.dtype != object and f.n * max(1, int(np.abs(x).max(initial=0))) + most < 2**62:
        return x * f.n - np.array(f.sums, dtype=np.int64)
    return x.astype(object) * f.n - np.array(f.sums, dtype=object)


def square_sums(y: np.ndarray) -> list[int]:
    if y.dtype == object or int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) >= 2**62:
        y = y.astype(object)
    return [int(v) for v in (y * y).sum(1)]


def apply(vectors: DataFrame, key: str, fits: dict[int, Fit]) -> DataFrame:
    """(key, d, deviation string, w array<double>) of valid vectors; fits are d by components, so small to send."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, c in by_length(b.column(1)):
                f = fits[c.shape[1]] if c.shape[1] else Fit(0, (), 0.0, np.zeros(0), np.zeros((0, 0)))
                y = centred(whole(c), f)
                w = (y / max(f.n, 1)).astype(float) @ f.axes / np.sqrt(f.values)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([c.shape[1]] * len(at), pa.int32()), pa.array([str(v) for v in square_sums(y)]), pa.array(list(w), pa.list_(pa.float64()))], names=names)

    names = [key, "d", "deviation", "w"]
    return vectors.select(key, "c").mapInArrow(run, f"`{key}` {vectors.schema[key].dataType.simpleString()}, d int, deviation string, w array<double>")


def moments(whitened: DataFrame) -> DataFrame:
    """(d, i, n, part, mean, row): means, and row i of the sums of products about them, merged from task to task."""
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}
        for b in batches:
            d = b.column(0).to_numpy()
            for k in np.unique(d):
                _, w = next(by_length(b.column(1).filter(pa.array(d == k))))
                mean = w.mean(0)
                new = len(w), mean, (w - mean).T @ (w - mean)
                seen[int(k)] = merged(seen[int(k)], new) if int(k) in seen else new
        part = TaskContext.get().partitionId()
        for d, (n, mean, m2) in seen.items():
            k = len(mean)
            yield pa.RecordBatch.from_pydict({"d": [d] * k, "i": list(range(k)), "n": [n] * k, "part": [part] * k, "mean": [mean.tolist()] * k, "row": m2.tolist()}, schema=schema)

    def add(t: pd.DataFrame) -> dict:
        i = t["i"].iloc[0]
        n, mean, row = t["n"].iloc[0], np.array(t["mean"].iloc[0]), np.array(t["row"].iloc[0])
        for m, other, more in zip(t["n"].iloc[1:], t["mean"].iloc[1:], t["row"].iloc[1:], strict=True):
            step = np.array(other) - mean
            row = row + np.array(more) + step[i] * step * (n * m / (n + m))
            n, mean = n + m, mean + step * (m / (n + m))
        return {"mean": mean.tolist(), "row": row.tolist()}

    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("part", pa.int32()), ("mean", pa.list_(pa.float64())), ("row", pa.list_(pa.float64()))])
    return tree(whitened.select("d", "w").mapInArrow(of_task, "d int, i int, n long, part int, mean array<double>, row array<double>"), add, "moments")


def merged(a: tuple, b: tuple) -> tuple:
    step, n = b[1] - a[1], a[0] + b[0]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation decimal, whitened, explained, identity_error): a row a valid vector and component.

    Rows whose vector is null or holds null or non-finite entries are left out; all others are the fit list, repeated rows
    as often as they come. Vectors of another length are whitened among themselves (d tells nothing apart where all are
    alike). Components are numbered by falling eigenvalue; of equal ones any order and sign, the same for all rows. Where the
    covariance has a lower rank than asked for, there are so many components only; for a single vector, equal vectors or
    vectors without entries none, hence no rows. A deviation of more than 38 digits is null. identity_error is measured on
    the whitened vectors themselves. Other columns are ignored. Empty table: no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    good = valid(vectors, key, column)
    fits = fit(good, components)
    done = stash(apply(good, key, fits), "whitened")
    errors: dict[int, float] = {}
    for r in moments(done.where(F.size("w") > 0)).toLocalIterator():  # components by lengths
        row = np.array(r.row) / r.n
        row[r.i] -= 1
        errors[r.d] = max(errors.get(r.d, 0.0), float(np.abs(row).max()))
    facts = [(d, k + 1, f.n, float(f.values[k] / f.trace), errors[d]) for d, f in fits.items() for k in range(len(f.values))]
    facts = spark.createDataFrame(facts, "d int, component int, n long, explained double, identity_error double")
    rows = done.select(key, "d", F.expr("try_cast(deviation as decimal(38, 0))").alias("deviation"), F.posexplode("w").alias("pos", "whitened")).withColumn("component", F.col("pos") + 1)
    return rows.join(F.broadcast(facts), ["d", "component"]).select(key, "component", "n", "deviation", "whitened", "explained", "identity_error")
