"""Detectors by name: a registry of models, each called as a table function beside the rows of a window table.

A model says what it finds in a piece of text and whether a piece fits into its context. register() turns one into a
Python table function of the session, so SQL can call it laterally; detections() is the same from a DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import structs
from spanloom.operators import spans, windows


class Detector:
    """A model. It is made anew in each task, so what it loads isn't sent around."""

    #: Raw labels that it may give, and the outcome that each stands for; what it gives beside these is not admitted.
    labels: dict[str, str] = {}

    def fits(self, text: str) -> bool:
        """Whether a piece is within the context limit; else it is cut into overlapping halves."""
        return True

    def predict(self, text: str) -> Iterable[tuple[int, int, str, float]]:
        """(start, end, raw label, score) in the piece."""
        raise NotImplementedError


REGISTRY: dict[str, type[Detector]] = {}


def detector(name: str):
    """Class decorator: the detector's name. A taken name is refused."""
    if not re.fullmatch("[a-z][a-z0-9_]*", name):
        raise ValueError(f"{name!r} can't name a function")

    def put(cls: type[Detector]) -> type[Detector]:
        if REGISTRY.setdefault(name, cls) is not cls:
            raise ValueError(f"there is a detector {name}")
        return cls

    return put


def known(name: str) -> type[Detector]:
    if name not in REGISTRY:
        raise ValueError(f"no detector {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


FOUND = "piece int, piece_start int, piece_end int, pos int, start int, end int, raw string, score double"


def register(spark: SparkSession, name: str) -> str:
    """Makes the detector a table function detect_<name>(text, at) of this session and returns its name.

    A row a detection, with places counted from `at` before the text's first character. Null text: no rows.
    """
    model = known(name)

    class Lateral:
        def __init__(self) -> None:
            self.model = model()

        def eval(self, text: str, at: int) -> Iterator[tuple]:
            for n, (a, b) in enumerate(windows.fitted(text, self.model.fits) if text is not None else ()):
                for i, (s, e, raw, score) in enumerate(self.model.predict(text[a:b])):
                    yield n, at + a, at + b, i, at + a + s, at + a + e, raw, float(score)

    spark.udtf.register(f"detect_{name}", F.udtf(Lateral, returnType=FOUND, useArrow=True))
    return f"detect_{name}"


@F.arrow_udf(structs("win", "at", part=T.StringType()))
def _parts(text: pa.Array, at: pa.Array) -> pa.Array:
    """The text of each window, cut by places, so that a long text is walked through once."""
    kind = pa.list_(pa.struct([("win", pa.int32()), ("at", pa.int32()), ("part", pa.string())]))
    return pa.array([[(w["win"], w["start"], t[w["start"]:w["end"]]) for w in x] for t, x in zip(text.to_pylist(), at.to_pylist(), strict=True)], kind)


def detections(docs: DataFrame, name: str, floor: float = 0.0, words: int = 150, stride: int = 75) -> DataFrame:
    """All that a detector finds in windows of whole texts, with status: ok, unknown_label, bad_bounds or below_floor.

    (doc_id, win, piece, piece_start, piece_end, doc_length, pos, start, end, label, raw, score, status). Texts are cut into
    windows of words, windows that don't fit into pieces; each window is a row of its own, so a long text is spread over
    tasks. Null texts have none.
    """
    spark, model = docs.sparkSession, known(name)
    d = docs.where("text is not null").select("doc_id", "text")
    w = windows.packed_windows(d, words, stride, "doc_id", "text").select("doc_id", F.col("size").alias("doc_length"), _parts("text", "windows").alias("w"))
    w = w.select("doc_id", "doc_length", F.inline_outer("w"))
    f = spark.sql(f"SELECT w.doc_id, w.win, w.doc_length, f.* FROM {{w}} w, LATERAL {register(spark, name)}(w.part, w.at) f", w=w)
    outcome = spark.createDataFrame(list(model.labels.items()), "label string, outcome string")
    f = spans.admit(f.withColumnsRenamed({"raw": "label", "doc_length": "length"}), outcome, floor)
    return f.join(F.broadcast(outcome), "label", "left").withColumnsRenamed({"label": "raw", "outcome": "label", "length": "doc_length"})


def accepted(found: DataFrame, margin: int = 1) -> DataFrame:
    """(doc_id, start, end, label, score): admitted detections, one for each span.

    What touches an inner edge of its piece, or has no more than margin characters before it, may be cut, and is left to the
    overlapping piece: a sign at the edge may belong to what was found, so one character is the least for such labels.
    """
    ok = found.where("status = 'ok'")
    inner = ((F.col("piece_start") > 0) & (F.col("start") <= F.col("piece_start") + margin)) | ((F.col("piece_end") < F.col("doc_length")) & (F.col("end") >= F.col("piece_end") - margin))
    order = F.col("win") * (1 << 16) + F.col("piece")
    return spans.stitch(ok.where(~inner).select("doc_id", "start", "end", "label", "score", order.alias("win"), "pos")).drop("win", "pos")


def outcomes(found: DataFrame) -> DataFrame:
    """(status, raw, n): what was admitted and what wasn't, by raw label."""
    return found.groupBy("status", "raw").agg(F.count("*").alias("n"))


@detector("patterns")
class Patterns(Detector):
    """E-mail addresses, and numbers of four digits as an example of a label that nothing admits; 800 characters at once."""

    labels = {"email": "EMAIL"}
    email = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    year = re.compile(r"(?<![0-9])[0-9]{4}(?![0-9])")

    def fits(self, text: str) -> bool:
        return len(text) <= 800

    def predict(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        for raw, pattern in (("email", self.email), ("year", self.year)):
            for m in pattern.finditer(text):
                yield m.start(), m.end(), raw, 1.0
