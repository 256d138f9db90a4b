"""The numbering plan against its rules one by one, and telephone numbers in texts as people write them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import detect, numbering
from spanloom.plans import demo

PLAN = numbering.compiled()


def rule_by_rule(digits: str) -> bool:
    """The rules that read most digits decide; one that refuses wins."""
    fits = [(len(numbering.places(p)), a, b) for p, a, b in numbering.RULES if re.match(p, digits)]
    last = [(a, b) for d, a, b in fits if d == max(x for x, *_ in fits)]
    return 7 <= len(digits) <= 15 and bool(last) and (0, 0) not in last and any(a <= len(digits) <= b for a, b in last)


def test_the_automaton_is_the_rules(spark):
    """Every head of a rule's prefix, filled up to all lengths; and all numbers of up to five digits with a common tail."""
    numbers = {str(n) + "2" * more for n in range(1, 100_000, 7) for more in (3, 5, 6, 7)} | {f"{n}55512{x:02}" for n in range(1201, 2000) for x in (1, 23)} | {"", "0", "1" * 40, "12125550100"}
    d = spark.createDataFrame([(n,) for n in sorted(numbers)], "n string")
    got = {r.n for r in d.where(numbering.valid(F.col("n"), PLAN)).collect()}
    assert got == {n for n in numbers if rule_by_rule(n)} and got
    assert len(PLAN.sizes) < 400


def test_null_digits_are_no_number(spark):
    assert [r.v for r in spark.createDataFrame([(None,)], "n string").select(numbering.valid(F.col("n"), PLAN).alias("v")).collect()] == [False]


WRITTEN = {
    "call 415-555-2671 now": ["415-555-2671"],
    "(415) 555-2671": ["(415) 555-2671"],
    "+1 (415) 555-2671.": ["+1 (415) 555-2671"],
    "1-415-555-2671, or 4155552671!": ["1-415-555-2671", "4155552671"],
    "ring +44 (0) 20 7946 0958 or +4915112345678": ["+44 (0) 20 7946 0958", "+4915112345678"],
    "011 44 20 7946 0958": ["011 44 20 7946 0958"],
    "order 12 415-555-2671": ["415-555-2671"],
    "(415-555-2671)": ["415-555-2671"],
    "415.555.2671 415.555.2672": ["415.555.2671", "415.555.2672"],
    "no: 415-555-2671-99, 192.168.100.2001, $4155552671, id4155552671, 4155552671px": [],
    "no area 152-555-2671, none 911-555-2671, none 415-155-2671": [],
    "2024-01-02 10:20:30, 3.1415926535, 12/31/1999": [],
    "415-555-2671 spans\n415-555-2672": ["415-555-2671", "415-555-2672"],
    "": [],
    "1 " * 3000: [],
}


def test_numbers_as_written(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(WRITTEN)] + [(99, None)], "doc_id long, text string")
    got = {}
    for r in numbering.phones(docs).collect():
        t = list(WRITTEN)[r.doc_id]
        assert t[r.start:r.end] == r.surface
        got.setdefault(r.doc_id, []).append((r.start, r.surface))
    assert {i: [s for _, s in sorted(got.get(i, []))] for i in range(len(WRITTEN))} == {i: want for i, want in enumerate(WRITTEN.values())}


def test_another_home(spark):
    docs = spark.createDataFrame([(1, "London 020 7946 0958, Paris 00 33 1 70 18 99 00, no 415-555-2671")], "doc_id long, text string")
    got = sorted(r.surface for r in numbering.phones(docs, numbering.Home("44", "0", "00")).collect())
    assert got == ["00 33 1 70 18 99 00", "020 7946 0958"]


def test_empty_table(spark):
    assert numbering.phones(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_detector_uses_the_plan(spark, sf):
    d = demo.documents(spark, sf)
    a = {tuple(r) for r in detect.validator_spans(d, ("phone",)).select("doc_id", "start", "end").collect()}
    assert a == {tuple(r) for r in numbering.phones(d).select("doc_id", "start", "end").collect()} and a


@pytest.mark.parametrize(("prefix", "sets"), [("1[2-9]", ["1", "23456789"]), ("4[1-57-9]0", ["4", "12345789", "0"])])
def test_places(prefix, sets):
    assert numbering.places(prefix) == [frozenset(s) for s in sets]
