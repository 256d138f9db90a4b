"""Linear-chain decoding over emission arrays: best path, log likelihood, exact span probabilities. Arrow batches: each
step depends on the one before, inside one sequence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Log weight of what the tag scheme forbids.
FORBIDDEN = -1e4


@dataclass(frozen=True)
class Scheme:
    """Outside, and begin, inside, end, single of each type: tag 0 and 1 + 4 * type + (0, 1, 2, 3)."""

    types: int

    @property
    def size(self) -> int:
        return 1 + 4 * self.types

    def allowed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(transitions, starts, ends) as booleans: inside an entity only its own inside or end may follow."""
        k, kind, own = self.size, np.array([-1, *([0, 1, 2, 3] * self.types)]), np.array([-1, *np.repeat(np.arange(self.types), 4)])
        opens, open_ = (kind == 0) | (kind == 3) | (kind == -1), (kind == 0) | (kind == 1)
        step = np.where(open_[:, None], (own[:, None] == own[None]) & ((kind == 1) | (kind == 2))[None], opens[None])
        return step.reshape(k, k), opens, ~open_


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass(frozen=True)
class Chain:
    scheme: Scheme
    step: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, types: int, step: np.ndarray | None = None, start: np.ndarray | None = None, end: np.ndarray | None = None) -> Chain:
        s = Scheme(types)
        masks = s.allowed()
        given = [np.zeros(m.shape) if g is None else np.asarray(g, float) for g, m in zip((step, start, end), masks, strict=True)]
        return cls(s, *(np.where(m, g, FORBIDDEN) for g, m in zip(given, masks, strict=True)))

    def forward(self, e: np.ndarray) -> tuple[np.ndarray, float]:
        a = np.empty_like(e)
        a[0] = self.start + e[0]
        for i in range(1, len(e)):
            a[i] = np.logaddexp.reduce(a[i - 1][:, None] + self.step, axis=0) + e[i]
        return a, float(np.logaddexp.reduce(a[-1] + self.end))

    def backward(self, e: np.ndarray) -> np.ndarray:
        b = np.empty_like(e)
        b[-1] = self.end
        for i in range(len(e) - 2, -1, -1):
            b[i] = np.logaddexp.reduce(self.step + (e[i + 1] + b[i + 1])[None], axis=1)
        return b

    def best(self, e: np.ndarray) -> list[int]:
        score, came = self.start + e[0], []
        for row in e[1:]:
            c = score[:, None] + self.step
            came.append(c.argmax(0))
            score = c.max(0) + row
        path = [int((score + self.end).argmax())]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        return path[::-1]

    def forward_all(self, e: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """forward() of many sequences in step: e (tokens, sequences, tags), the longest sequence first."""
        a = np.empty_like(e)
        a[0] = self.start + e[0]
        for i in range(1, len(e)):
            k = np.searchsorted(-sizes, -i)  # those with more than i tokens
            a[i, :k] = _log_sum(a[i - 1, :k, :, None] + self.step, 1) + e[i, :k]
        return a, _log_sum(a[sizes - 1, np.arange(len(sizes))] + self.end, 1)

    def backward_all(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        b = np.empty_like(e)
        b[sizes - 1, np.arange(len(sizes))] = self.end
        for i in range(len(e) - 2, -1, -1):
            k = np.searchsorted(-sizes, -(i + 1))
            b[i, :k] = _log_sum(self.step + (e[i + 1, :k] + b[i + 1, :k])[:, None], 2)
        return b

    def best_all(self, e: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """best() of many sequences in step."""
        score, came, n = self.start + e[0], np.empty(e.shape, np.int32), np.arange(len(sizes))
        for i in range(1, len(e)):
            k = np.searchsorted(-sizes, -i)
            c = score[:k, :, None] + self.step
            came[i, :k] = c.argmax(1)
            score[:k] = c.max(1) + e[i, :k]
        at, path = (score + self.end).argmax(1), np.empty(e.shape[:2], np.int32)
        for i in range(len(e) - 1, -1, -1):
            k = np.searchsorted(-sizes, -i)
            path[i, :k] = at[:k]
            if i:
                at[:k] = came[i, n[:k], at[:k]]
        return [path[:size, j].tolist() for j, size in enumerate(sizes)]

    def loss(self, e: np.ndarray, ok: np.ndarray) -> float:
        """Negative log probability of all paths through the allowed tags of each token."""
        return self.forward(e)[1] - self.forward(np.where(ok, e, FORBIDDEN))[1]

    def spans(self, e: np.ndarray, floor: float = 0.01, longest: int = 64, sums: tuple | None = None) -> list[tuple[int, int, int, float]]:
        """(first, last, type, probability) of every segment at or above the floor, at most `longest` tokens.

        sums: what forward() and backward() say, if they are there. A segment is no likelier than its first tag, which rules out most starts; inside sums come from running totals.
        """
        a, z, b = sums or (*self.forward(e), self.backward(e))
        out, n, low = [], len(e), np.log(floor)

        def found(first: np.ndarray, last: np.ndarray, t: int, p: np.ndarray) -> None:
            out.extend(zip(first.tolist(), last.tolist(), [t] * len(p), np.exp(np.minimum(0.0, p)).tolist(), strict=True))

        for t in range(self.scheme.types):
            begin, inside, last, single = range(1 + 4 * t, 5 + 4 * t)
            p = a[:, single] + b[:, single] - z
            one = np.flatnonzero(p >= low)
            found(one, one, t, p[one])
            run = np.cumsum(e[:, inside] + self.step[inside, inside])
            for some in np.array_split(np.flatnonzero(a[:, begin] + b[:, begin] - z >= low), max(1, n // 4096)):
                i = some[:, None]
                j = np.minimum(i + np.arange(1, longest), n - 1)
                # through k inside tokens: into the first, between them, out of the last
                through = np.where(j > i + 1, self.step[begin, inside] + run[j - 1] - run[i] - self.step[inside, inside] + self.step[inside, last], self.step[begin, last])
                p = a[i, begin] + through + e[j, last] + b[j, last] - z
                x, y = np.nonzero((p >= low) & (i + np.arange(1, longest) < n))
                found(some[x], j[x, y], t, p[x, y])
        return out


def reachable(chain: Chain, ok: np.ndarray) -> bool:
    """Whether some path stays within the allowed tags."""
    step, start, end = chain.scheme.allowed()
    at = start & ok[0]
    for row in ok[1:]:
        at = (at[:, None] & step).any(0) & row
    return bool((at & end).any())


def decode(sequences: DataFrame, chain: Chain) -> DataFrame:
    """sequences (.., emissions array<array<double>>) with path array<int>; an empty sequence has an empty path."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(emissions: pa.Array) -> pa.Array:
        paths: list[list[int]] = [[] for _ in range(len(emissions))]
        for rows, e, sizes in _blocks(emissions):
            for i, path in zip(rows, chain.best_all(e, sizes), strict=True):
                paths[i] = path
        return pa.array(paths, pa.list_(pa.int32()))

    return sequences.withColumn("path", run(F.col("emissions").cast("array<array<double>>")))


#: Numbers of a block of sequences that are decoded in step, padding included; a longer sequence is a block of its own.
BLOCK = 1 << 20


def _blocks(emissions: pa.ListArray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, (tokens, sequences, tags), sizes) of sequences that are alike in length, the longest first."""
    each = sorted(_sequences(emissions), key=lambda x: -len(x[1]))
    while each:
        n = max(1, min(len(each), BLOCK // each[0][1].size))
        some, each = each[:n], each[n:]
        e = np.zeros((len(some[0][1]), n, some[0][1].shape[1]))
        for j, (_, x) in enumerate(some):
            e[:len(x), j] = x
        yield [i for i, _ in some], e, np.array([len(x) for _, x in some])


def _sequences(emissions: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, matrix) of the sequences of a batch that aren't empty, cut from its flat numbers."""
    outer, inner, flat = emissions.offsets.to_numpy(), emissions.values.offsets.to_numpy(), emissions.values.values.to_numpy(zero_copy_only=False)
    valid = emissions.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(emissions)):
        lo, hi = outer[i], outer[i + 1]
        if valid[i] and hi > lo:
            yield i, flat[inner[lo]:inner[hi]].reshape(hi - lo, -1)


def span_probabilities(sequences: DataFrame, chain: Chain, floor: float = 0.01, longest: int = 64) -> DataFrame:
    """(doc_id, first, last, type, probability), one row a segment."""
    kind = sequences.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, block, sizes in _blocks(b.column(1)):
                a, z = chain.forward_all(block, sizes)
                back = chain.backward_all(block, sizes)
                for j, (i, n) in enumerate(zip(rows, sizes, strict=True)):
                    found = chain.spans(block[:n, j], floor, longest, (a[:n, j], float(z[j]), back[:n, j]))
                    if not found:
                        continue
                    first, last, t, p = (np.array(x) for x in zip(*found, strict=True))
                    ids = b.column(0).take(pa.array(np.full(len(found), i)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(t, pa.int32()), pa.array(p, pa.float64())], ["doc_id", "first", "last", "type", "probability"])

    return sequences.select("doc_id", F.col("emissions").cast("array<array<double>>")).mapInArrow(run, f"doc_id {kind}, first int, last int, type int, probability double")
