"""Sinks: JSON lines, prediction files, ledger, snapshots and stores that only take new rows."""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"


def write_jsonl(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    docs.write.mode(mode).json(path)


def write_predictions(preds: DataFrame, meta: dict, path: str) -> None:
    """Rows and one header line; Spark's commit makes them appear together."""
    spark = preds.sparkSession
    head = spark.createDataFrame([(json.dumps({"_meta": meta}),)], "value string")
    head.unionByName(preds.select(F.to_json(F.struct("doc_id", "spans")).alias("value"))).write.mode("overwrite").text(path)


def append_ledger(spark: SparkSession, path: str, row: dict, headline: bool = False, revision: str | None = None) -> None:
    """One stamped row. A headline row needs a clean, known revision."""
    if headline and (not revision or revision.endswith("-dirty")):
        raise ValueError(f"headline rows need a clean revision, not {revision}")
    stamp = {"ts": datetime.datetime.now(datetime.timezone.utc).isoformat(), "revision": revision, "version": VERSION, "headline": headline}
    spark.createDataFrame([(*stamp.values(), json.dumps(row, sort_keys=True))], "ts string, revision string, version string, headline boolean, payload string").write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts string, revision string, version string, headline boolean, payload string").json(path)


def export_flat(ledger: DataFrame, fields: dict[str, str], path: str) -> None:
    """Chosen payload fields (column: JSON path) as Parquet columns."""
    ledger.select("ts", "revision", "headline", *[F.get_json_object("payload", p).alias(c) for c, p in fields.items()]).write.mode("overwrite").parquet(path)


def dataset_hash(docs: DataFrame) -> str:
    """16 hex digits over ids and text digests in order of id: digests by piece of the id's hash, then over the pieces.

    Only the 4,096 piece digests come together, so the order never needs all rows in one task.
    """
    d = docs.select(F.col("doc_id").cast("string").alias("k"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("h")).withColumn("piece", F.substring(F.sha2("k", 256), 1, 3))
    pieces = d.groupBy("piece").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "k", "h"))), "\n"), 256).alias("h"))
    return pieces.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("piece", "h"))), ""), 256), 1, 16)).first()[0]


def write_snapshot(docs: DataFrame, path: str, taxonomy: str, **more: str) -> dict:
    """Data first, then the header that makes it valid."""
    docs.write.mode("overwrite").parquet(f"{path}/data")
    spark = docs.sparkSession
    meta = {"taxonomy": taxonomy, "dataset_hash": dataset_hash(spark.read.parquet(f"{path}/data")), **more}
    spark.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{path}/meta")
    return meta


def valid_snapshot(spark: SparkSession, path: str, taxonomy: str) -> DataFrame | None:
    """The stored rows if header, taxonomy version and content agree."""
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        data = spark.read.parquet(f"{path}/data")
    except Exception as e:  # noqa: BLE001  a missing path has no class of its own in Spark
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return data if meta.get("taxonomy") == taxonomy and meta.get("dataset_hash") == dataset_hash(data) else None


def materialize(split: DataFrame, path: str) -> None:
    """docs with part (see splits.hash_split), a folder for each part."""
    split.write.mode("overwrite").partitionBy("part").parquet(path)


def add_new(rows: DataFrame, key: str, path: str) -> int:
    """Appends rows whose key the store lacks; returns how many."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


#: Shards of a feature store, and those that are written between two lines of its manifest.
SHARDS, WAVE = 64, 16
_MANIFEST = "shard long, content string, rows long, at double"


def _contents(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """rows with shard, by hash of the key."""
    return rows.withColumn("shard", F.pmod(F.xxhash64(F.col(key)), F.lit(shards)))


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  a missing path has no class of its own in Spark
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def store_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content, rows): the shards of a store that are whole, by their last line."""
    lines = _read_or_none(spark, f"{path}/manifest")
    if lines is None:
        return spark.createDataFrame([], "shard long, content string, rows long")
    last = lines.groupBy("shard").agg(F.max_by(F.struct("content", "rows"), "at").alias("x")).select("shard", "x.*")
    return last.where("rows > 0")


def write_store(rows: DataFrame, path: str, key: str, features: Callable[[DataFrame], DataFrame] = lambda d: d, identity: str = "", shards: int = SHARDS, wave: int = WAVE) -> list[int]:
    """Writes features(rows) by shard, only for shards whose content isn't in the store; returns the shards it wrote.

    A shard's content is a hash over its rows, whatever their order, and identity, which names what features does. Shards
    are written a wave at a time, each wave over those it replaces, and then entered in the manifest: a write that is cut
    off is taken up after its last whole wave, and what readers see is always whole. Shards that rows no longer has are
    entered as empty. features keeps key and may not mix rows of different keys.
    """
    spark = rows.sparkSession
    d = _contents(rows, key, shards)
    digest = F.sum(F.xxhash64(F.lit(identity), *[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)"))
    now = d.groupBy("shard").agg(F.concat_ws(":", digest.cast("string"), F.count("*").cast("string")).alias("content"), F.count("*").alias("rows"))
    have = store_manifest(spark, path)
    todo = now.join(have.select("shard", "content"), ["shard", "content"], "left_anti").unionByName(have.join(now, "shard", "left_anti").select("shard", F.lit("").alias("content"), F.lit(0).cast("long").alias("rows")))
    todo = sorted((r.shard, r.content, r.rows) for r in todo.collect())  # a row a shard
    for i in range(0, len(todo), wave):
        some = todo[i:i + wave]
        full = [s for s, _, n in some if n]
        if full:
            out = _contents(features(d.where(F.col("shard").isin(full)).drop("shard")), key, shards)
            out.repartition(len(full), "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/data")
        spark.createDataFrame([(*x, time.time()) for x in some], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return [s for s, _, n in todo if n]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of whole shards."""
    return spark.read.parquet(f"{path}/data").join(F.broadcast(store_manifest(spark, path).select("shard")), "shard", "left_semi").drop("shard")


def write_result(spark: SparkSession, result: dict, path: str) -> None:
    """One JSON object; Spark's commit makes it appear whole or not at all, also over an older one."""
    spark.createDataFrame([(json.dumps(result, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_result(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
