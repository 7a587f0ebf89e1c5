"""Closed-form statistics as column expressions, and tests that need a sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it within a function of elements."""
    return F.get(F.transform(F.array(value), body), 0)


def softmax(logits: Column) -> Column:
    """Of an array of logits."""
    raised = let(F.struct(logits.alias("x"), F.array_max(logits).alias("top")), lambda s: F.transform(s["x"], lambda v: F.exp(v - s["top"])))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return let(raised, lambda e: let(F.struct(e.alias("e"), total(e).alias("t")), lambda s: F.transform(s["e"], lambda v: v / s["t"])))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """``low, high`` of the Wilson interval of k of n, within [0, 1]; null for n = 0."""
    p = F.try_divide(k, n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high")))


def log_choose(n: Column, k: Column) -> Column:
    """ln(n over k) as a sum of logarithms; for n up to some thousands."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.ln((n - k + i) / i))
    return F.when(k <= 0, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided probability of b against c discordant pairs; 1 without any."""
    n, low = b + c, F.least(b, c)
    tail = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), low), lambda i: F.exp(log_choose(n, i) - n * F.ln(F.lit(2.0)))), F.lit(0.0), lambda a, x: a + x)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def binomial_upper(k: Column, n: Column, p: float) -> Column:
    """Exact probability of k or more of n at a rate of p; null for n = 0."""
    import math

    odds = p / (1 - p)
    first = F.exp(log_choose(n, k) + k * math.log(p) + (n - k) * math.log(1 - p))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct((acc["term"] * (n - i) / (i + 1) * odds).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    return F.when(n > 0, F.least(F.lit(1.0), F.aggregate(F.sequence(k.cast("long"), n.cast("long")), start, step, lambda acc: acc["sum"])))


def within(low: Column, high: Column, margin: float) -> Column:
    """Practical equivalence: the interval lies within plus or minus the margin."""
    return (low > -margin) & (high < margin)


def smoothed(values: Column, weight: float) -> Column:
    """Exponential smoothing with correction of the start, value by value."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("last"), F.lit(1.0).alias("left"))

    def step(acc: Column, x: Column) -> Column:
        last, left = acc["last"] * weight + x * (1 - weight), acc["left"] * weight
        return F.struct(F.concat(acc["out"], F.array(last / (1 - left))).alias("out"), last.alias("last"), left.alias("left"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def entropy(logits: Column) -> Column:
    """Of the softmax of an array of logits."""
    return let(softmax(logits), lambda p: -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
