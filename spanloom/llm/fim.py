"""Fill-in-middle: texts cut at lines into prefix, middle and suffix, and put together again with sentinels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from spanloom.llm.common import small_batches

#: A line with its end, or the last line without one. The same pieces as `[^\n]*\n|[^\n]+`, but no line is read twice.
LINES = r"[^\n]+\n?|\n"
#: The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


@dataclass(frozen=True)
class Plan:
    """How texts are cut: seed of the draws, percent of texts that are transformed, percent of these in the spm form, units."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    units: str = LINES


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document; a missing doc_id is an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, doc_id: int | None, splitter: Split, plan: Plan) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = [end for _, (_, end) in splitter.pre_tokenize_str(text)]  # code points
    n = len(ends)
    h1, h2, h3, h4 = draws(plan.seed, doc_id)
    if not text or h3 % 100 >= plan.rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    ends.append(0)  # before the first unit: rank 0 reads it as ends[-1]
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[a - 1], ends[b - 1]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < plan.spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row for each row of docs: doc_id, n (units), form, prefix_chars, middle_chars (code points) and output.

    The units are the offsets that the tokenizers library's Split gives for isolated matches; nothing is trained. Where the
    two cuts fall is drawn from the seed and doc_id alone, so reruns and repeated rows agree. The form is plain, with null
    lengths and the text as its output, for empty texts, texts that hold a sentinel and those not drawn. Null texts are
    empty; a null doc_id is drawn as an empty one. Equal cuts leave the middle empty. Texts are read whole; other columns
    are ignored. Empty table: no rows. No shuffle: a row depends on itself alone.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Split(Regex(plan.units), "isolated")
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(i, *cut(t.as_py() or "", i, splitter, plan)) for i, t in zip(ids, b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * len(OUT), OUT, strict=True)], schema=OUT)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of; exact, as no transformed text holds a sentinel."""
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)

    def two(second: str) -> tuple[Column, Column]:
        rest = F.substring(head, len(PREFIX) + 1, 2**31 - 1)
        return F.substring_index(rest, second, 1), F.substring_index(rest, second, -1)

    prefix, suffix = two(SUFFIX)
    spm_suffix, spm_prefix = two(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(spm_prefix, middle, spm_suffix))


def digest(cuts: DataFrame) -> DataFrame:
    """The contract's columns of transform()."""
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
