"""Language identification: text likelihood fused with declared language, address suffix and host priors."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import small_batches
from spanloom.session import stash

#: Labelled texts of each language that the character model is fitted on, languages (the most frequent), and n-grams (the
#: most frequent of the sample), at most.
SAMPLE_ROWS, LANGUAGES, GRAMS = 400, 64, 1 << 18
#: Characters of an n-gram; share of a text's log likelihood that counts (n-grams of a text are not independent).
GRAM, TEMPER = 3, 0.1
#: Weight of the parent level in host counts, and of the uniform share in the tables for declarations and suffixes.
HOST_PRIOR, TABLE_PRIOR = 5.0, 1.0
#: Words whose likelihoods a worker remembers.
MEMORY = 300_000
#: Rows up to which a table of groups is broadcast (some hundred bytes each); a larger one is shuffled, and its keys with
#: more than 1 / HOT_SHARE of all rows, HOT_SHARE at most, are dealt over SALTS tasks each.
BROADCAST_ROWS, HOT_SHARE, SALTS = 200_000, 2_000, 64

WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)")
TAG = re.compile(r"<[^<>]*>")
OPEN = re.compile(r"(?i)<(html|meta)\b([^<>]*)")
ATTRIBUTE = re.compile(r"(?i)(?<![a-z-])([a-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
CODE = re.compile(r"(?i)\s*([a-z]{2,3})(?![a-z])")


@dataclass(frozen=True)
class CharModel:
    """Log probabilities of the last character of each n-gram of a word, by language; rows of the matrix are n-grams."""

    langs: tuple[str, ...]
    rows: dict[str, int]
    logp: np.ndarray  # (n-grams + 1, languages); the last row is for those that training lacks

    def word(self, w: str) -> np.ndarray:
        padded = f"  {w} "
        other = len(self.logp) - 1
        return self.logp[[self.rows.get(padded[i:i + GRAM], other) for i in range(len(padded) - GRAM + 1)]].sum(axis=0)


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> CharModel:
    """Fit on at most rows texts of each declared language of docs (text, lang), the first by hash of the id.

    Languages are those with any such text, the LANGUAGES most frequent of them, in order. Rows without text, lang or id
    are not learned from. Rows are thinned by hash to about twice as many as are asked for before they are ranked, so no
    task ranks a whole language; n-grams are counted where the texts are, and only counts come to the driver.
    """
    d = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string"))
    sizes = {r.lang: r["count"] for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return fit({}, ())
    share = docs.sparkSession.createDataFrame([(k, min(1.0, (2 * rows + 100) / n)) for k, n in sizes.items()], "lang string, share double")
    draw = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    thin = d.withColumn("draw", draw).join(F.broadcast(share), "lang").where("draw < share")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = stash(thin.select("lang", "doc_id", "draw").distinct().withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", "doc_id"), "lang-sample")
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for g, k in grams(text).items():
                    n[lang, g] += k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "gram", "n"])

    texts = d.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "text")  # rows * LANGUAGES ids at most
    n = stash(texts.mapInArrow(count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "lang-grams")
    top = n.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(GRAMS)
    counts: dict[str, Counter[str]] = {x: Counter() for x in sorted(sizes)}
    for r in n.join(F.broadcast(top), "gram").select("lang", "gram", "n").toLocalIterator():
        counts[r.lang][r.gram] = r.n
    return fit(counts, tuple(sorted(sizes)))


def grams(text: str) -> Counter[str]:
    out: Counter[str] = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        padded = f"  {w} "
        for i in range(len(padded) - GRAM + 1):
            out[padded[i:i + GRAM]] += n
    return out


def fit(counts: dict[str, Counter[str]], langs: tuple[str, ...]) -> CharModel:
    seen = sorted(set().union(*counts.values())) if langs else []
    m = np.zeros((len(seen) + 1, max(1, len(langs))))
    for j, lang in enumerate(langs):
        context: dict[str, int] = defaultdict(int)
        for g, n in counts[lang].items():
            context[g[:-1]] += n
        letters = 64.0
        for i, g in enumerate(seen):
            m[i, j] = math.log((counts[lang][g] + 0.5) / (context.get(g[:-1], 0) + 0.5 * letters))
        m[-1, j] = math.log(1 / letters)
    return CharModel(langs, {g: i for i, g in enumerate(seen)}, m)


def shown(source: str) -> str:
    """A page without comments, scripts and styles, which hold neither text nor tags."""
    return HIDDEN.sub(" ", source)


def page_text(tags: str) -> str:
    return html.unescape(TAG.sub(" ", tags))


def declared(tags: str) -> str | None:
    """Language that a tag of shown() declares, wherever it stands; the html tag goes before meta tags."""
    meta = None
    for m in OPEN.finditer(tags):
        said = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[2])}
        if m[1].lower() == "html":
            if found := CODE.match(said.get("lang", "")):
                return found[1].lower()
        elif meta is None and "content-language" in (said.get("http-equiv", "").lower(), said.get("name", "").lower()):
            if found := CODE.match(said.get("content", "")):
                meta = found[1].lower()
    return meta


def evidence(rows: DataFrame, model: CharModel) -> DataFrame:
    """rows (.., body, markup boolean) with ll array<double>, n_words and declared; body is read whole."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        table = np.empty((1024, len(model.langs) or 1))
        for bodies, marks in batches:
            out = []
            for body, mark in zip(bodies, marks, strict=True):
                body = shown(body or "") if mark else body or ""
                said = declared(body) if mark else None
                words = WORD.findall((page_text(body) if mark else body).lower())
                total = np.zeros(len(model.langs) or 1)
                for a in range(0, len(words), 4096):
                    if len(known) > MEMORY:
                        known.clear()
                    at = []
                    for w in words[a:a + 4096]:
                        i = known.get(w)
                        if i is None:
                            i = known[w] = len(known)
                            if i >= len(table):
                                table = np.concatenate([table, np.empty_like(table)])
                            table[i] = model.word(w)
                        at.append(i)
                    total += table[at].sum(axis=0)
                out.append({"ll": total.tolist(), "n_words": len(words), "declared": said})
            yield pd.DataFrame(out, columns=["ll", "n_words", "declared"])

    udf = F.pandas_udf(run, "struct<ll: array<double>, n_words: bigint, declared: string>")
    kept = [c for c in rows.columns if c not in ("body", "markup")]
    return rows.select(*kept, udf(F.col("body").cast("string"), F.col("markup")).alias("found")).select(*kept, "found.*")


def _posterior(logs):
    """Array of log weights to probabilities."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _sums(n: int, c: str = "p"):
    return F.array(*[F.sum(F.get(c, F.lit(j))) for j in range(n)])


def _add(a, b):
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def _minus(a, b):
    return F.zip_with(a, b, lambda x, y: F.greatest(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), F.lit(0.0)))


def looked_up(rows: DataFrame, sums: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of sums (a row a key, with its number of rows `members`) by key; null where there is none.

    A small table is broadcast. Else rows without a key are scattered, as they match nothing, and rows of the hottest
    keys are dealt over SALTS tasks, to each of which the key's sums go.
    """
    if sums.count() <= broadcast_rows:
        return rows.join(F.broadcast(sums.drop("members")), key, "left")
    every = rows.count()
    hot = F.broadcast(sums.where(F.col("members") * HOT_SHARE > every).select(F.col(key).alias("hot_key")))  # HOT_SHARE keys at most
    dealt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    a = rows.join(hot, rows[key] == F.col("hot_key"), "left")
    a = a.withColumn("salt", F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64("row"), F.lit(1 << 20))).when(F.col("hot_key").isNotNull(), dealt).otherwise(0)).drop("hot_key")
    b = sums.drop("members").join(hot, sums[key] == F.col("hot_key"), "left")
    b = b.withColumn("salt", F.explode(F.when(F.col("hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot_key")
    b = b.withColumnRenamed(key, "of_key").withColumnRenamed("salt", "of_salt")
    return a.join(b, F.coalesce(a[key], F.lit("")).eqNullSafe(b["of_key"]) & (a["salt"] == b["of_salt"]), "left").drop("of_key", "of_salt", "salt")


def fuse(rows: DataFrame, langs: tuple[str, ...], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows (row, .., ll, host, domain, suffix, declared) with lang, probability, text_lang.

    p is the posterior from the text alone. Grouped sums of p give: all rows; by domain, smoothed by all; by host,
    smoothed by its domain; and how often a declaration or suffix goes with a language. A row's own p is taken out of
    its host's sums, and a missing host, suffix or declaration is no evidence. Group tables have a row a key.
    """
    n = len(langs)
    zero = F.array(*[F.lit(0.0)] * n)
    rows = stash(rows.withColumn("p", _posterior(F.transform("ll", lambda x: x * TEMPER))), "lang-rows")
    every = rows.agg(*[F.sum(F.get("p", F.lit(j))).alias(f"s{j}") for j in range(n)]).first()
    total = [float(every[j] or 0.0) + 1.0 for j in range(n)]
    base = F.array(*[F.lit(x / sum(total)) for x in total])

    d = rows
    for key, name in (("domain", "by_domain"), ("host", "by_host"), ("declared", "by_declared"), ("suffix", "by_suffix")):
        sums = stash(rows.where(F.col(key).isNotNull()).groupBy(key).agg(_sums(n).alias(name), F.count("*").alias("members")), name)
        d = looked_up(d, sums, key, broadcast_rows).withColumn(name, F.coalesce(name, zero))

    def mean(counts, prior, weight: float):
        size = F.aggregate(counts, F.lit(0.0), lambda a, y: a + y)
        return F.zip_with(counts, prior, lambda c, q: (c + weight * q) / (size + weight))

    own = F.when(F.col("host").isNotNull(), F.col("p")).otherwise(zero)
    d = d.withColumn("prior", mean(_minus(F.col("by_domain"), own), base, HOST_PRIOR))
    d = d.withColumn("prior", mean(_minus(F.col("by_host"), own), F.col("prior"), HOST_PRIOR))

    def likelihood(name: str, key: str):
        # P(value | language) up to what is the same for all languages
        ratio = F.zip_with(F.col(name), F.array(*[F.lit(x) for x in total]), lambda c, t: (c + TABLE_PRIOR * t / F.lit(sum(total))) / t)
        return F.when(F.col(key).isNotNull(), F.transform(ratio, lambda x: F.log(x))).otherwise(zero)

    logs = _add(_add(F.transform("ll", lambda x: x * TEMPER), F.transform("prior", lambda x: F.log(x))), _add(likelihood("by_declared", "declared"), likelihood("by_suffix", "suffix")))
    d = d.withColumn("post", _posterior(logs))
    names = F.array(*[F.lit(x) for x in langs])
    pick = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return d.withColumn("lang", pick(F.col("post"))).withColumn("probability", F.array_max("post")).withColumn("text_lang", F.when(F.col("n_words") > 0, pick(F.col("p"))))


def identify(docs: DataFrame, pages: DataFrame, model: CharModel | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, page_id, lang, probability, text_lang, declared, host, n_words): one row a document and one a page.

    Documents bring text, and their source as host; pages bring markup, url and the text between tags. A null or empty
    text leaves the other evidence; with none at all the language is the most frequent one. Ties go to the first
    language in order. Repeated rows count each. Other columns are ignored. No labelled texts: lang is null. Texts and
    pages are read whole, in time proportional to their length; a batch holds few, so memory follows the longest ones.
    """
    model = model or learn(docs)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    a = docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id"), F.col("text").alias("body"), F.lit(False).alias("markup"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"))
    b = pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"), F.col("html").alias("body"), F.lit(True).alias("markup"), host.alias("host"))
    b = b.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    rows = evidence(a.unionByName(b).withColumn("row", F.monotonically_increasing_id()), model)
    if not model.langs:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", "host", "n_words")
    return fuse(rows, model.langs, broadcast_rows).select("doc_id", "page_id", "lang", "probability", "text_lang", "declared", "host", "n_words")
