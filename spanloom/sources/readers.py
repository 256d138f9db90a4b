"""Readers: annotated corpora of several shapes to (doc_id, text, cluster_id, spans) rows, before label mapping."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import surface_key
from spanloom.schema import DOC

RAW_SPAN = "array<struct<start:int,end:int,label:string,surface:string,source:string>>"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One document a line; blank lines are skipped."""
    return spark.read.schema(DOC).json(path)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing fields {missing}; there are {sorted(df.columns)}")
    return df


def refused(message: Column | str) -> Column:
    """raise_error for rows that get here. It names the file, which keeps conditions on what is raised for from being moved
    ahead of earlier ones: there Spark would work out a shared part of them, and raise, for rows that those leave out."""
    file = F.input_file_name()
    return F.raise_error(F.concat(F.lit(message) if isinstance(message, str) else message, F.when(file != "", F.concat(F.lit(", file "), file)).otherwise("")))


def court_cases(records: DataFrame) -> DataFrame:
    """records (doc_id, text, annotations map<annotator, struct<entity_mentions array<struct>>>): all annotators' mentions,
    labelled entity/identifier."""
    require(records, "doc_id", "text", "annotations")
    each = F.flatten(F.transform(F.map_entries("annotations"), lambda a: F.transform(a["value"]["entity_mentions"], lambda m: F.struct(
        m["start_offset"].cast("int").alias("start"), m["end_offset"].cast("int").alias("end"), F.concat_ws("/", m["entity_type"], m["identifier_type"]).alias("label"),
        m["span_text"].alias("surface"), F.concat(F.lit("gold:"), a["key"]).alias("source")))))
    return records.select("doc_id", "text", F.col("doc_id").alias("cluster_id"), each.cast(RAW_SPAN).alias("spans"), F.size("annotations").alias("n_annotators"))


def token_rows(records: DataFrame) -> DataFrame:
    """records (doc_id, tokens, trailing_whitespace, ent_tags) to (doc_id, pos, token, space, tag, start)."""
    require(records, "doc_id", "tokens", "trailing_whitespace", "ent_tags")
    same = (F.size("tokens") == F.size("trailing_whitespace")) & (F.size("tokens") == F.size("ent_tags"))
    ok = records.withColumn("_z", F.when(same, F.arrays_zip("tokens", "trailing_whitespace", "ent_tags")).otherwise(refused(F.concat(F.lit("token lengths differ in "), F.col("doc_id").cast("string")))))
    t = ok.repartition("doc_id").select("doc_id", F.posexplode("_z").alias("pos", "z")).select("doc_id", "pos", F.col("z.tokens").alias("token"), F.col("z.trailing_whitespace").alias("space"), F.col("z.ent_tags").alias("tag"))
    size = F.length("token") + F.col("space").cast("int")
    return t.withColumn("start", F.coalesce(F.sum(size).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))


def bio_spans(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, label) from BIO tags: an I- tag of another type than the token before it opens a span."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = tokens.withColumn("label", F.when(F.col("tag").rlike("^[BI]-"), F.substring("tag", 3, 1000)))
    opens = F.col("label").isNotNull() & (F.col("tag").startswith("B-") | ~F.coalesce(F.lag("label").over(w) == F.col("label"), F.lit(False)))
    t = t.withColumn("island", F.sum(opens.cast("int")).over(w)).where("label is not null")
    return t.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("token")).cast("int").alias("end"), F.first("label").alias("label")).drop("island")


def token_corpus(records: DataFrame) -> DataFrame:
    """Documents rebuilt from tokens, with spans from tags; a placeholder in braces that was not filled is an error."""
    t = token_rows(records)
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.concat("token", F.when(F.col("space"), " ").otherwise("")).alias("t"))))
    text = t.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("text"))
    spans = bio_spans(t).join(text, "doc_id").withColumn("surface", F.expr("substring(text, start + 1, end - start)"))
    spans = spans.withColumn("surface", F.when(F.col("surface").contains("{") & F.col("surface").contains("}"), F.raise_error(F.concat(F.lit("unfilled placeholder "), F.col("surface")))).otherwise(F.col("surface")))
    grouped = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "surface", F.lit("gold").alias("source")))).alias("spans"))
    return text.join(grouped, "doc_id", "left").select("doc_id", "text", F.col("doc_id").alias("cluster_id"), F.coalesce("spans", F.array().cast(RAW_SPAN)).alias("spans"))


def fill_placeholders(records: DataFrame, salt: str) -> DataFrame:
    """Each B- token of a type gets a value drawn by hash, the same one throughout a record; its words become B-, I- ..."""
    pick = lambda kind, n: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id"), F.lit(kind)), F.lit(n))
    names = F.array(*[F.lit(x) for x in ("Ada Byron", "Max Born", "Lise Meitner", "Emmy Noether")])
    values = F.create_map(
        F.lit("NAME"), F.get(names, pick("name", 4).cast("int")), F.lit("EMAIL"), F.concat(F.lit("user"), pick("mail", 10_000).cast("string"), F.lit("@example.com")),
        F.lit("PHONE_NUM"), F.concat(F.lit("+1 202 555 "), F.lpad(pick("phone", 10_000).cast("string"), 4, "0")), F.lit("ADDRESS"), F.concat(pick("house", 200).cast("string"), F.lit(" Mill Road")),
        F.lit("URL"), F.concat(F.lit("https://example.org/"), pick("url", 10_000).cast("string")), F.lit("USERNAME"), F.concat(F.lit("reader"), pick("user", 10_000).cast("string")),
        F.lit("ID_NUM"), F.lpad(pick("id", 1_000_000_000).cast("string"), 9, "0"),
    )
    d = require(records, "doc_id", "tokens", "trailing_whitespace", "ent_tags").withColumn("_v", values)
    row = lambda t, s, g: F.struct(t.alias("t"), s.alias("s"), g.alias("g"))

    def grow(z: Column) -> Column:
        kind, words = F.substring(z["ent_tags"], 3, 1000), F.split(F.col("_v")[F.substring(z["ent_tags"], 3, 1000)], " ")
        full = F.transform(words, lambda w, i: row(w, F.when(i < F.size(words) - 1, True).otherwise(z["trailing_whitespace"]), F.concat(F.when(i == 0, "B-").otherwise("I-"), kind)))
        return F.when(z["ent_tags"].startswith("B-") & F.col("_v")[kind].isNotNull(), full).otherwise(F.array(row(z["tokens"], z["trailing_whitespace"], z["ent_tags"])))

    out = d.withColumn("_z", F.flatten(F.transform(F.arrays_zip("tokens", "trailing_whitespace", "ent_tags"), grow)))
    return out.select("doc_id", F.col("_z.t").alias("tokens"), F.col("_z.s").alias("trailing_whitespace"), F.col("_z.g").alias("ent_tags"))


PREFIXES = (("system", "System: "), ("user", "User: "), ("assistant", "Assistant: "))


def conversation_parts(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) in order of turn and role, with prefix, and base: where the message begins."""
    names = F.create_map(*[F.lit(x) for r in PREFIXES for x in r])
    ranks = F.create_map(*[F.lit(x) for i, (r, _) in enumerate(PREFIXES) for x in (r, i)])
    t = turns.where(F.col("text").isNotNull()).withColumn("prefix", names[F.col("role")]).withColumn("ord", ranks[F.col("role")]).where("prefix is not null")
    w = Window.partitionBy("conv_id").orderBy("turn", "ord", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("prefix") + F.length("text") + 1).over(w), F.lit(0))
    return t.withColumn("at", before.cast("int")).withColumn("base", (before + F.length("prefix")).cast("int"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, text, ignore): a message a line after its role; ignore holds the ranges of the prefixes."""
    p = conversation_parts(turns)
    rows = F.array_sort(F.collect_list(F.struct("at", "base", F.concat("prefix", "text", F.lit("\n")).alias("line"))))
    d = p.groupBy("conv_id").agg(rows.alias("r"))
    return d.select("conv_id", F.array_join(F.transform("r", lambda x: x["line"]), "").alias("text"), F.transform("r", lambda x: F.struct(x["at"].alias("start"), x["base"].alias("end"))).alias("ignore"))


def rebase_spans(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """Spans (conv_id, turn, role, start, end, ..) of messages to offsets in the conversation; a missing message raises."""
    j = spans.join(conversation_parts(turns).select("conv_id", "turn", "role", "base"), ["conv_id", "turn", "role"], "left")
    base = F.when(F.col("base").isNull(), F.raise_error(F.lit("span of a missing message"))).otherwise(F.col("base"))
    return j.withColumn("start", base + F.col("start")).withColumn("end", base + F.col("end")).drop("base")


def zipped(columns: Column, names: tuple[str, ...]) -> Column:
    """A struct of arrays as an array of structs; ragged ones raise."""
    even = F.lit(True)
    for n in names[1:]:
        even = even & (F.size(columns[n]) == F.size(columns[names[0]]))
    rows = F.transform(F.sequence(F.lit(0), F.size(columns[names[0]]) - 1), lambda i: F.struct(*[F.get(columns[n], i).alias(n) for n in names]))
    return F.when(~even, refused("ragged nested columns")).when(F.size(columns[names[0]]) > 0, rows)


def parse_spans(c: Column) -> Column:
    """Spans as JSON text, or as a Python literal with single quotes; null if neither."""
    shape = "array<struct<start:string,end:string,label:string,text:string,value:string>>"
    literal = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("'"), F.lit('"')), r"\bNone\b", "null"), r"\b(?i:(true|false))\b", "$1")
    return F.coalesce(F.from_json(c, shape), F.from_json(literal, shape))


def json_spans(records: DataFrame, dataset: str, text: str, spans: str, doc_key: Column, cluster: Column | None = None, fold_surface: bool = False) -> DataFrame:
    """Text with spans as JSON. fold_surface: a surface that equals its slice but for case becomes the slice."""
    require(records, text, spans)
    d = records.withColumn("_s", parse_spans(F.col(spans)))
    d = d.withColumn("_s", F.when(F.col("_s").isNull() & F.col(spans).isNotNull(), refused("spans are neither JSON nor a literal")).otherwise(F.col("_s")))

    def one(s: Column) -> Column:
        start, end, said = s["start"].try_cast("int"), s["end"].try_cast("int"), F.coalesce(s["text"], s["value"])
        cut = F.substring(F.col(text), start + 1, end - start)
        fixed = F.when(surface_key(cut) == surface_key(said), cut).otherwise(said) if fold_surface else said
        return F.struct(start.alias("start"), end.alias("end"), s["label"].alias("label"), fixed.alias("surface"), F.lit("gold").alias("source"))

    doc_id = F.concat(F.lit(dataset + "_"), doc_key.cast("string"))
    group = doc_id if cluster is None else F.coalesce(F.concat(F.lit(dataset + ":"), cluster.cast("string")), doc_id)
    return d.select(doc_id.alias("doc_id"), F.col(text).alias("text"), group.alias("cluster_id"), F.transform("_s", one).alias("spans"))


def text_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def read_predictions(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The header object and the rows (doc_id, spans) of a prediction file of JSON lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.where(F.get_json_object("value", "$._meta").isNotNull()).select(F.get_json_object("value", "$._meta")).limit(2).collect()
    if len(head) != 1:
        raise ValueError(f"{path}: {len(head)} header lines")
    shape = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("spans", DOC["spans"].dataType)])
    rows = lines.where(F.get_json_object("value", "$._meta").isNull()).select(F.from_json("value", shape).alias("r")).select("r.*")
    return json.loads(head[0][0]), rows


def prediction_index(headers: DataFrame) -> DataFrame:
    """headers (system, docs_path, path), one row each (system, docs key); two files for one raise."""
    g = headers.groupBy("system", F.regexp_replace("docs_path", "^file:/*", "/").alias("docs_key")).agg(F.count("*").alias("n"), F.min("path").alias("path"))
    twice = g.where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"duplicate prediction files: {[(r.system, r.docs_key) for r in twice]}")
    return g.drop("n")


def json_config(spark: SparkSession, path: str) -> dict:
    """A small JSON or YAML file through Spark's reader."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text)


def checked_file(spark: SparkSession, path: str, sha256: str) -> str:
    """path, if its content has the pinned hash."""
    got = hashlib.sha256(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])).hexdigest()
    if got != sha256:
        raise ValueError(f"{path}: hash {got} is not the pinned {sha256}")
    return path


def training_log(lines: DataFrame, pattern: str = r"run (\S+).*?step (\d+).*?loss ([0-9.]+)") -> DataFrame:
    """lines (value) to (run, step, loss); others are skipped."""
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.where(F.col("value").rlike(pattern)).select(part(1).alias("run"), part(2).cast("int").alias("step"), part(3).cast("double").alias("loss"))


def tolerant_json(lines: DataFrame, shape: str) -> DataFrame:
    """Rows of a JSON-lines text; malformed lines are left out."""
    r = lines.select(F.from_json("value", shape + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return r.where("_bad is null").drop("_bad")
