"""Corpora as Spark sources: a registered data source reads files of records, and a recipe makes each corpus's documents.

spark.read.format("corpus_records") yields (file, pos, record, fault): a partition a file, a hash pinned for each file that
has one, and a fault in place of an exception for each record that is no JSON object. recipe() parses the records with
Spark's own readers, applies the corpus's settings and sets aside what can't be used.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanloom.session import stash
from spanloom.sources import readers

SCHEMA = "file string, pos long, record string, fault string"


@dataclass
class File(InputPartition):
    path: str
    sha256: str | None


class CorpusRecords(DataSource):
    """Options: path (a file or folder of any file system that pyarrow knows), hashes (JSON object: file name to SHA-256),
    layout (lines: a record a line; array: a file is one JSON array)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


class RecordReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.layout = options["path"], options.get("layout", "lines")
        self.hashes = json.loads(options.get("hashes", "{}"))
        if self.layout not in ("lines", "array"):
            raise ValueError(f"layout is lines or array, not {self.layout}")

    def files(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        return system, sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[File]:
        _, paths = self.files()
        names = {p.rsplit("/", 1)[-1] for p in paths}
        if lost := sorted(set(self.hashes) - names):
            raise ValueError(f"pinned files that aren't there: {lost}")
        return [File(p, self.hashes.get(p.rsplit("/", 1)[-1])) for p in paths]

    def read(self, partition: File) -> Iterator[tuple]:
        system, _ = self.files()
        if partition.sha256:  # before a record is let out
            digest = hashlib.sha256()
            with system.open_input_stream(partition.path) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            if digest.hexdigest() != partition.sha256:
                raise ValueError(f"{partition.path}: hash {digest.hexdigest()} is not the pinned {partition.sha256}")
        name = partition.path.rsplit("/", 1)[-1]
        with system.open_input_stream(partition.path) as f:
            rows = json.loads(f.read()) if self.layout == "array" else lines(f)
            for i, row in enumerate(rows):
                yield name, i, *checked(row if isinstance(row, bytes) else json.dumps(row, ensure_ascii=False).encode())


def lines(f) -> Iterator[bytes]:
    """Lines of a stream that aren't blank, a block at a time."""
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


def checked(row: bytes) -> tuple[str, str | None]:
    """(record, fault)."""
    try:
        said = row.decode("utf-8")
    except UnicodeDecodeError:
        return row.decode("utf-8", "replace"), "no UTF-8"
    try:
        return said, None if isinstance(json.loads(said), dict) else "no object"
    except ValueError:
        return said, "no JSON"


@dataclass(frozen=True)
class Recipe:
    """shape: a record's fields; build: records to (doc_id, text, cluster_id, spans); keep: a condition on records.

    needed: fields without which a record is set aside.
    """

    shape: str
    build: str
    needed: tuple[str, ...]
    dataset: str
    keep: str = "true"
    key: str = "id"
    cluster: str | None = None
    fold: bool = False
    text: str = "text"
    spans: str = "spans"
    layout: str = "lines"


_MENTION = "struct<start_offset:int,end_offset:int,span_text:string,entity_type:string,identifier_type:string>"
_COURT = f"doc_id string, text string, annotations map<string,struct<entity_mentions:array<{_MENTION}>>>"
_TOKENS = "doc_id string, tokens array<string>, trailing_whitespace array<boolean>, ent_tags array<string>"
#: The fields of each corpus, its language and what groups its documents.
RECIPES = {
    "tab_direct": Recipe(_COURT, "court", ("doc_id", "text", "annotations"), "tab", layout="array"),
    "tab_quasi": Recipe(_COURT, "court", ("doc_id", "text", "annotations"), "tab", layout="array"),
    "spy_medical": Recipe(_TOKENS, "tokens", ("tokens", "trailing_whitespace", "ent_tags"), "spy"),
    "spy_legal": Recipe(_TOKENS, "tokens", ("tokens", "trailing_whitespace", "ent_tags"), "spy"),
    "pii_trace": Recipe("conv_id string, messages array<struct<turn:int,role:string,text:string>>, spans array<struct<turn:int,role:string,start:int,end:int,label:string,surface:string>>", "turns", ("conv_id", "messages"), "pii_trace"),
    "nemotron": Recipe("uid string, locale string, domain string, document_type string, text string, spans string", "json", ("text", "uid"), "nemotron", key="concat_ws('-', uid, locale)", cluster="concat_ws('|', domain, document_type)", fold=True),
    "gretel": Recipe("index string, language string, document_type string, expanded_type string, generated_text string, pii_spans string", "json", ("generated_text",), "gretel", "language = 'English'", "index", "concat_ws('|', document_type, expanded_type)", text="generated_text", spans="pii_spans"),
    "ai4privacy": Recipe("id string, language string, source_text string, privacy_mask string", "json", ("source_text",), "ai4privacy", "language = 'en'", text="source_text", spans="privacy_mask"),
    "fresh_real": Recipe("doc_id string, text string, cluster_id string, spans string", "json", ("doc_id", "text"), "fresh_real", key="doc_id", cluster="cluster_id"),
}


def load(spark: SparkSession, path: str, layout: str = "lines", hashes: dict[str, str] | None = None) -> DataFrame:
    spark.dataSource.register(CorpusRecords)
    return spark.read.format("corpus_records").option("path", path).option("layout", layout).option("hashes", json.dumps(hashes or {})).load()


def recipe(spark: SparkSession, name: str, path: str, hashes: dict[str, str] | None = None, salt: str = "fill") -> tuple[DataFrame, DataFrame]:
    """((doc_id, text, cluster_id, spans) of a corpus, (file, pos, fault, record) of what was set aside).

    A record goes aside that is no JSON object, lacks a field the corpus needs, or has spans that don't parse; the others
    are read. A file whose hash isn't the pinned one stops the read. Documents without an id of their own get one from
    their text.
    """
    r = RECIPES[name]
    raw = load(spark, path, r.layout, hashes).withColumn("r", F.from_json("record", r.shape))
    lacks = F.array_compact(F.array(*[F.when(F.col(f"r.{c}").isNull(), c) for c in r.needed]))
    fault = F.coalesce("fault", F.when(F.col("r").isNull(), "shape"), F.when(F.size(lacks) > 0, F.concat(F.lit("lacks "), F.array_join(lacks, ", "))))
    if r.build == "json":
        fault = F.coalesce(fault, F.when(F.col(f"r.{r.spans}").isNotNull() & readers.parse_spans(F.col(f"r.{r.spans}")).isNull(), "spans"))
    if r.build == "tokens":
        uneven = (F.size("r.tokens") != F.size("r.trailing_whitespace")) | (F.size("r.tokens") != F.size("r.ent_tags"))
        fault = F.coalesce(fault, F.when(uneven, "token lengths"))
    raw = raw.withColumn("fault", fault)
    if r.build == "tokens":  # the optimizer may look at tokens before it drops what goes aside
        raw = raw.withColumn("r", F.when(F.col("fault").isNull(), F.col("r")).otherwise(F.struct(F.lit(None).cast("string").alias("doc_id"), F.array().cast("array<string>").alias("tokens"), F.array().cast("array<boolean>").alias("trailing_whitespace"), F.array().cast("array<string>").alias("ent_tags"))))
    raw = stash(raw.withColumn("record", F.when(F.col("fault").isNotNull(), F.col("record"))), name)  # files are read and parsed once
    aside = raw.where("fault is not null").select("file", "pos", "fault", "record")
    good = raw.where("fault is null").select("file", "pos", "r.*").where(r.keep)
    return _build(good, r, name, salt), aside


def _own_key(r: Recipe) -> Column:
    """The record's id; without one, from its text."""
    return F.coalesce(F.nullif(F.expr(r.key), F.lit("")), readers.text_key(F.col(r.text)))


def _build(good: DataFrame, r: Recipe, name: str, salt: str) -> DataFrame:
    cols = ("doc_id", "text", "cluster_id", "spans")
    if r.build == "court":
        return readers.court_cases(good).select(*cols)
    if r.build == "tokens":
        named = good.withColumn("doc_id", F.concat(F.lit(f"{name}_"), F.coalesce("doc_id", F.concat_ws("-", "file", F.col("pos").cast("string")))))
        return readers.token_corpus(readers.fill_placeholders(named, salt)).select(*cols)
    if r.build == "turns":
        turns = good.select("conv_id", F.explode("messages").alias("m")).select("conv_id", "m.*")
        spans = readers.rebase_spans(good.select("conv_id", F.explode("spans").alias("s")).select("conv_id", "s.*"), turns)
        one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", "surface", F.lit("gold").alias("source"))
        docs = readers.conversations(turns).join(spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("spans")), "conv_id", "left")
        return docs.select(F.concat(F.lit(f"{r.dataset}_"), "conv_id").alias("doc_id"), "text", F.col("conv_id").alias("cluster_id"), F.coalesce("spans", F.array().cast(readers.RAW_SPAN)).alias("spans"))
    cluster = None if r.cluster is None else F.expr(r.cluster)
    return readers.json_spans(good, r.dataset, r.text, r.spans, _own_key(r), cluster, r.fold).select(*cols)
