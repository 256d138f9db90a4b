"""Structured Streaming: detectors on arriving documents, idempotent appends, windowed event counts, sessions of state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.detect import LABELS, PATTERNS


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def surfaces(docs: DataFrame, kinds: tuple[str, ...] = ("email", "ssn")) -> DataFrame:
    """(doc_id, kind, label, surface) without state: matches stay in their row, so batches can be of any size."""
    found = F.concat(*[_hits(k) for k in kinds])
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


def _hits(kind: str):
    all_ = F.regexp_extract_all("text", F.lit(f"({PATTERNS[kind]})"), 1)
    return F.transform(all_, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(LABELS[kind]).alias("label"), s.alias("surface")))


def append_once(stream: DataFrame, path: str, checkpoint: str):
    """Each micro-batch to its own folder, overwritten if it is run again, so that a retry adds nothing twice."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of value by event type in windows of event time; what is later than the watermark is left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, value) after each batch: state kept a user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, v = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, v = n + len(f), v + float(f["value"].fillna(0).sum())
        state.update((n, v))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "value": [v]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, value double", "n long, value double", "update", "NoTimeout")
