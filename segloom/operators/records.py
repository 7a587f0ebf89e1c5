"""Operators on record streams: done records, last versions, guards, judge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remaining(items: DataFrame, done: DataFrame, key: str, only: Column | None = None) -> DataFrame:
    """Items whose key isn't done. ``only`` says which rows of ``done`` count (all: failed ones count as done, too)."""
    rows = done if only is None else done.filter(only)
    return items.join(rows.select(key).distinct(), key, "left_anti")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def guarded(df: DataFrame, faults: DataFrame, message: str) -> DataFrame:
    """``df``, raising an error when it runs if ``faults`` has a row."""
    check = faults.limit(1).agg(F.count("*").alias("_faults")).select(F.when(F.col("_faults") > 0, F.raise_error(F.lit(message))).otherwise(F.lit(0)).cast("int").alias("_ok"))
    return df.join(F.broadcast(check), F.col("_ok") == 0).drop("_ok")


def only_columns(df: DataFrame, allowed: set[str]) -> DataFrame:
    """``df`` itself if it has no column beyond the allowed ones, so that no label leaks in; else an error."""
    extra = sorted(set(df.columns) - allowed)
    if extra:
        raise ValueError(f"columns that must not be there: {', '.join(extra)}")
    return df


def first_reason(rules: list[tuple[Column, str]], otherwise: str = "") -> Column:
    """The name of the first rule that holds; a rule that is null doesn't hold."""
    out = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out.otherwise(otherwise)


def mean_of_present(scores: list[tuple[Column, Column]]) -> Column:
    """Mean of the scores whose judge is present (``(present, score)``); a present judge without a score counts as 0, none gives 0."""
    total = sum((F.when(p, F.coalesce(s, F.lit(0.0))).otherwise(0.0) for p, s in scores[1:]), F.when(scores[0][0], F.coalesce(scores[0][1], F.lit(0.0))).otherwise(0.0))
    n = sum((p.cast("int") for p, _ in scores[1:]), scores[0][0].cast("int"))
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def given_or_mean(given: Column, dimensions: list[Column]) -> Column:
    """The given average unless it is null or 0, else the mean of the dimensions with missing ones as 0."""
    parts = [F.coalesce(d.cast("double"), F.lit(0.0)) for d in dimensions]
    return F.coalesce(F.nullif(given.cast("double"), F.lit(0.0)), sum(parts[1:], parts[0]) / len(parts))
