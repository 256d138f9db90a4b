"""Record shapes: documents with nested spans, and the long span table that operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Outcomes, in the order that type indexes follow.
PII_TYPES = ("PERSON", "ADDRESS", "EMAIL", "PHONE", "URL", "DATE", "ACCOUNT_NUMBER", "SECRET", "OTHER_PII")
IGNORE, NOT_PII = "IGNORE", "NOT_PII"
OUTCOMES = (*PII_TYPES, IGNORE, NOT_PII)

SPAN = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("label_canonical", T.StringType()), T.StructField("label_raw", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("source", T.StringType()), T.StructField("surface", T.StringType()),
])
DOC = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("dataset", T.StringType()), T.StructField("split", T.StringType()), T.StructField("cluster_id", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])


class SpanError(ValueError):
    """Rows that break a constraint; the message names some."""


def is_pii(label: Column) -> Column:
    return label.isin(*PII_TYPES)


def span_fault(text: Column, start: Column, end: Column, surface: Column | None = None, label: Column | None = None, score: Column | None = None) -> Column:
    """Why a span is invalid, null if it isn't. Offsets are half-open and count code points."""
    fault = F.when(start.isNull() | end.isNull(), "offset missing").when((start < 0) | (end <= start) | (end > F.length(text)), "offset out of range")
    if label is not None:
        fault = fault.when(label.isNull() | ~label.isin(*OUTCOMES), "unknown label")
    if score is not None:
        fault = fault.when(~score.between(0, 1), "score out of range")
    if surface is not None:
        fault = fault.when(surface.isNotNull() & (F.substring(text, start + 1, end - start) != surface), "surface mismatch")
    return fault


def long_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, start, end, label, raw, score, source, surface) of docs with a spans array."""
    d = docs.select("doc_id", F.posexplode("spans").alias("pos", "s"))
    return d.select("doc_id", "pos", "s.start", "s.end", F.col("s.label_canonical").alias("label"), F.col("s.label_raw").alias("raw"), "s.score", "s.source", "s.surface")


def ensure_none(bad: DataFrame, message: str, show: int = 5) -> None:
    """Raises with a few examples if bad has rows."""
    rows = bad.limit(show).collect()
    if rows:
        raise SpanError(f"{message}: {[tuple(r) for r in rows]}")


def validate_predictions(docs: DataFrame, preds: DataFrame) -> None:
    """Predictions must belong to a document and lie in it; all documents need an entry, which may be empty."""
    ensure_none(preds.join(docs, "doc_id", "left_anti").select("doc_id"), "predictions of unknown documents")
    fault = span_fault(F.col("text"), F.col("start"), F.col("end"))
    ensure_none(preds.join(docs.select("doc_id", "text"), "doc_id").where(fault.isNotNull()).select("doc_id", "start", "end"), "invalid offsets")
