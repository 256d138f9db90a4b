"""URL filter: allow and block rules by host and path, else a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, small_batches

UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
AFTER_HOST = re.compile(r"([^/?#]*)([^?#]*)")


@dataclass(frozen=True)
class Rule:
    """allow or block for a host, its subdomains, and paths that begin with path. Written host + path, like example.org/es/."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: Terms that reject alone. No letter may stand beside a term, but where it is
#: open (*) it is a part of longer words.
STRICT = (
    "porn", "porns", "porno*", "pornhub*", "pornstar*", "freeporn*", "xxx", "hentai*", "camsex*", "sexcam*", "sexchat*", "sextube*", "sexvideo*", "sexfilm*", "milf", "milfs", "gangbang*", "blowjob*", "cumshot*", "bukkake*",
    "upskirt*", "onlyfans*", "*nacktbilder", "ficken", "fickfilm*", "huren", "salope*", "putas", "follar",
)
#: Terms that count with others, and their weights: 2 for the topic itself, 1 for what also stands in clean addresses.
SOFT = {
    **dict.fromkeys(("sex", "sexy", "sexe", "sexo", "erotic*", "erotik*", "erotiq*", "escort", "escorts", "nude", "nudes", "naked", "nackt", "fetish*", "adult", "adults", "casino*", "kasino*", "poker", "roulette", "gambling", "betting", "wetten", "apuestas", "viagra*", "cialis*", "levitra*", "warez", "keygen*", "torrent*"), 2),
    **dict.fromkeys(("bet", "bets", "slots", "jackpot*", "bonus", "gratis", "cheap", "billig", "pills", "dating", "hot", "girls", "teens", "babes", "webcam*", "cam", "cams", "tube", "crack", "cracked", "serial", "payday"), 1),
}
#: A page goes with so many distinct soft terms whose weights reach so much.
LEAST_SOFT, SOFT_WEIGHT = 2, 4

_OUT = "host string, path string, rule string, verdict string, n_strict long, n_soft long, soft_weight long"


def address(url: str | None) -> tuple[str, str]:
    """(host, path): what stands after the first `://`, the host in lower case. Both empty without `://`."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host, path = AFTER_HOST.match(url, at + 3).groups()
    return host.translate(UPPER), path


class Book:
    """Rules by host, and under a host by path, so that a url costs its labels and the path lengths there, not the rules."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.by_host: dict[str, dict[str, str]] = defaultdict(dict)
        for r in rules:
            old = self.by_host[r.host].get(r.path)
            self.by_host[r.host][r.path] = "block" if old == "block" else r.verdict
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in self.by_host.items()}

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, of equally long ones that with the longer host."""
        best: tuple[int, str, str] | None = None
        at = 0
        while host:
            name = host[at:]
            for n in self.lengths.get(name, ()):
                if n <= len(path) and (v := self.by_host[name].get(path[:n])):
                    if best is None or len(name) + n > best[0]:
                        best = len(name) + n, name + path[:n], v
                    break
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return best and best[1:]


class Vocabulary:
    """All terms in one automaton: a url is read once, whatever their number."""

    def __init__(self, strict: tuple[str, ...], soft: dict[str, int]) -> None:
        self.weights = {**soft, **dict.fromkeys(strict, 0)}
        self.strict = frozenset(strict)
        by_core: dict[str, list[tuple[str, bool, bool]]] = defaultdict(list)
        for t in self.weights:
            by_core[t.strip("*")].append((t, t.startswith("*"), t.endswith("*")))
        self.automaton = ahocorasick.Automaton()
        for core, terms in by_core.items():
            self.automaton.add_word(core, (len(core), terms))
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms of a url in lower case."""
        strict: set[str] = set()
        soft: set[str] = set()
        for end, (size, terms) in self.automaton.iter(url):
            start = end + 1 - size
            left = start == 0 or not url[start - 1].isalpha()
            right = end + 1 == len(url) or not url[end + 1].isalpha()
            for term, open_left, open_right in terms:
                if (left or open_left) and (right or open_right):
                    (strict if term in self.strict else soft).add(term)
        return strict, soft


def judged(url: Column, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, int] | None = None) -> Column:
    """struct<host, path, rule, verdict, n_strict, n_soft, soft_weight> of a url, in Arrow batches.

    A rule that fits decides; else one strict term, or LEAST_SOFT distinct soft terms with SOFT_WEIGHT together. Terms
    are looked for in the whole url, as it stands, in lower case (A-Z). Without `://` no rule fits, but terms count. A null
    url has no terms and is allowed.
    """
    own_soft = SOFT if soft is None else soft

    @F.pandas_udf(f"struct<{_OUT.replace(' ', ': ').replace(',:', ',')}>")
    def judge_urls(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        book, terms = Book(rules), Vocabulary(strict, own_soft)
        for urls in batches:
            out = []
            for u in urls:
                host, path = address(u)
                hard, mild = terms.hits((u or "").translate(UPPER))
                weight = sum(terms.weights[t] for t in mild)
                bad = bool(hard) or len(mild) >= LEAST_SOFT and weight >= SOFT_WEIGHT
                rule, verdict = book.find(host, path) or (None, "block" if bad else "allow")
                out.append((host, path, rule, verdict, len(hard), len(mild), weight))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"])

    return judge_urls(url.cast("string"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, int] | None = None) -> DataFrame:
    """One row for each row of pages: page_id, and what judged() says of its url.

    Null and empty urls have empty host and path and are allowed; urls are read whole; repeated rows are judged each and
    alike. Rules with the same host and path are one, which blocks if one of them does. Other columns are ignored, whatever
    their names. Empty table: no rows. No shuffle.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", judged(F.col("url"), rules, strict, soft).alias("x")).select("page_id", "x.*")


def allowed(pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, int] | None = None) -> DataFrame:
    """The rows of pages whose url is allowed, with pages' columns alone. Edges as in judge()."""
    small_batches(pages.sparkSession)
    x = fresh(pages, "judged")
    return pages.withColumn(x, judged(F.col("url"), rules, strict, soft)).where(F.col(f"{x}.verdict") == "allow").select(*pages.columns)
