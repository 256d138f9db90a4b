"""Thresholds, bins, probability vectors and hash draws as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import bind

#: Bin 0: no prediction; 1 + floor(1000 * score); a threshold of grid index k masks bins from 1 + k on.
BINS, MASK_NOTHING = 1002, 1.001


def k_of(t: float) -> int:
    return min(1001, max(0, math.ceil(round(t * 1000, 6))))


def k_of_column(t: Column) -> Column:
    return F.least(F.lit(1001), F.greatest(F.lit(0), F.ceil(F.bround(t * 1000, 6)))).cast("int")


def bin_of(score: Column) -> Column:
    return F.when(score.isNull() | (score < 0), 0).otherwise(1 + F.floor(F.least(score, F.lit(1.0)) * 1000 + 1e-9)).cast("int")


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared characters by those of the hull."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / hull).otherwise(0.0)


def unit(salt: Column | str, *keys: Column, sep: str = "|") -> Column:
    """A draw in [0, 1] from the first 8 hex digits of sha256(salt sep keys)."""
    text = F.concat_ws(sep, F.lit(salt) if isinstance(salt, str) else salt, *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") / F.lit(float(0xFFFFFFFF))


def ratio(a: Column, b: Column) -> Column:
    """NaN without a denominator."""
    return F.when(b > 0, a / b).otherwise(F.lit(float("nan")))


def f1(p: Column, r: Column) -> Column:
    return F.when(~F.isnan(p) & ~F.isnan(r) & (p + r > 0), 2 * p * r / (p + r)).otherwise(F.lit(float("nan")))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def normalised(p: Column) -> Column:
    return bind(total(p), lambda z: F.transform(p, lambda x: x / z))


def argmax(p: Column) -> Column:
    """Index of the first largest."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    return normalised(bind(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp((x - m) / t))))


def retempered(p: Column, temperature: float) -> Column:
    return softmax(F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-30)))), temperature)


def confidence(p: Column) -> Column:
    """One less the entropy's share of its most."""
    entropy = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return 1 - entropy / F.log(F.size(p).cast("double"))


def fault_of(p: Column, n: Column) -> Column:
    """Why a probability vector is invalid; null if it isn't."""
    return F.when(p.isNull() | (F.size(p) != n), "length").when(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))), "value").when(total(p) <= 0, "mass")


def expected(p: Column, values: Column) -> Column:
    return total(F.zip_with(p, values, lambda x, v: x * v))


def failed_answer(n: Column, right: Column) -> Column:
    """What a failed call counts as: even over all wrong options."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == right, 0.0).otherwise(1.0 / (n - 1)))


def sensitive_score(pb: Column, none: Column, plain: Column) -> Column:
    """Boundary probability times that of a sensitive label: less none and the labels that aren't (array)."""
    return pb * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - none - total(plain)))


def power_of_two(n: Column, least: int = 128) -> Column:
    return F.greatest(F.lit(least), F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("int"))
