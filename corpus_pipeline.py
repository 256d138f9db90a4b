"""Training-corpus pipeline over documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, linededup, mixing, simhash, toxicity
from spanloom.llm.common import fresh
from spanloom.session import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.3 for toxicity; the lexicon is learned from the table's labels.

    Null and empty texts score 0 and stay; repeated rows are judged each, and alike; texts are read whole. Without labels
    the seed lexicon judges. All columns stay, whatever their names. Empty table: no rows.
    """
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs, "score"), fresh(docs, "clauses")
    return toxicity.score(docs, lexicon, names).where(F.col(names[0]) < 0.3).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document, or an earlier place of theirs, holds.

    Null, empty and wordless texts and rows without doc_id stay as they are; a row left without a word goes. Rows of one
    doc_id with different texts are rows of their own; rows alike in both lose the same lines. Of tied lines the first by
    (doc_id, text hash, line) stays. n_chars is renewed where a text changes; all other columns stay. Texts are read
    whole. Empty table: no rows.
    """
    return linededup.drop_lines(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of SimHash near-duplicates, by doc_id (none last), then by the text's MD5.

    Null, empty and wordless texts are one group, of which one row stays; of rows alike in doc_id and text one stays; a
    doc_id that repeats with another text is another row. Texts are read whole; all columns stay. Empty table: no rows.
    """
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item.

    Null and empty texts and items hold nothing. Rows are told apart by doc_id and text, so of a repeated doc_id only
    the rows with an item go; rows without doc_id go by their text. Texts are read whole; all columns stay. Empty tables:
    docs as they are.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row that is left: how often the mix takes its words.

    Null texts have size 0; a null source is a source of its own; repeated rows count each, and ties in the shuffled
    order go by doc_id, then size. Other columns don't matter. Empty table: no rows.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
]

#: SQL can't learn the lexicon, hash shingles with XXH64 or close groups here; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order; each result is written to the shared folder and read as the next stage's docs."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
