"""Bootstrap intervals of ratios of sums, and of paired differences of such ratios.

Poisson resampling: in each repetition a unit (a clip, a pair) counts a number of times drawn from the Poisson law of mean
1. The draws of a unit are a polynomial of the repetition's number over a prime field, whose four coefficients come from
the MD5 of seed and key; any four repetitions of a unit are so independent, and SQL can make the same draws. Nothing is
collected and no unit is copied: a task turns its units into a matrix of weights, multiplies it with their statistics and
hands on one row of sums a repetition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.session import ship

PRIME = 2**31 - 1
#: Up to this often a unit is drawn in a repetition; more has a chance below 1e-10.
MOST_DRAWS = 12
#: A value below the i-th edge is drawn at most i times.
EDGES = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(i + 1))) for i in range(MOST_DRAWS)]
_CHUNK = 256


def coefficients(key: str, seed: int) -> list[Column]:
    """Four numbers below PRIME of a unit's key, in text as SQL casts it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return [(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") % PRIME).alias(f"_c{i}") for i in range(4)]


def _sums(stats: int, repetitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps = np.arange(1, repetitions + 1, dtype=np.int64)
        edges, total, seen = np.array(EDGES), np.zeros((repetitions, stats)), False
        for batch in batches:
            c = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            s = np.stack([batch.column(4 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(stats)], axis=1)
            s = np.nan_to_num(s)
            for at in range(0, len(s), _CHUNK):
                part = [x[at : at + _CHUNK, None] for x in c]
                x = part[3] * reps % PRIME
                for i in (2, 1):
                    x = (x + part[i]) * reps % PRIME
                x = (x + part[0]) % PRIME
                total += np.searchsorted(edges, x, side="right").astype(float).T @ s[at : at + _CHUNK]
                seen = True
        if seen:
            yield pa.record_batch([pa.array(reps), *(pa.array(total[:, i]) for i in range(stats))], ["rep", *(f"s{i}" for i in range(stats))])

    return run


def resampled(units: DataFrame, key: str, stats: list[str], repetitions: int, seed: int) -> DataFrame:
    """``rep`` and the sum of each statistic in it. A null statistic counts 0, units without a key are left out."""
    ship(units.sparkSession)
    rows = units.filter(F.col(key).isNotNull()).select(*coefficients(key, seed), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(stats)))
    schema = "rep long, " + ", ".join(f"s{i} double" for i in range(len(stats)))
    by = rows.mapInArrow(_sums(len(stats), repetitions), schema).groupBy("rep")
    return by.agg(*(F.sum(f"s{i}").alias(c) for i, c in enumerate(stats)))


def intervals(units: DataFrame, key: str, metrics: dict[str, Column], stats: list[str], repetitions: int = 2000, seed: int = 41, shares: tuple[float, ...] = (0.95, 0.9)) -> DataFrame:
    """``metric, estimate, low_95, high_95, low_90, high_90, repetitions``: each metric of the sums with its percentile intervals.

    metrics: name and an expression over the sums of ``stats``, say a ratio, or a difference of the ratios of two arms.
    """
    known = [c for s in shares for c in (f"low_{round(100 * s)}", f"high_{round(100 * s)}")]
    long = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), e.alias("x")) for m, e in metrics.items()))).alias("v")).select("v.*")
    cut = [c for s in shares for c in ((1 - s) / 2, (1 + s) / 2)]
    spread = long(resampled(units, key, stats, repetitions, seed)).groupBy("metric").agg(
        *(F.percentile("x", q).alias(n) for q, n in zip(cut, known)), F.count("*").alias("repetitions")
    )
    point = long(units.filter(F.col(key).isNotNull()).agg(*(F.sum(c).cast("double").alias(c) for c in stats))).withColumnRenamed("x", "estimate")
    return point.join(F.broadcast(spread), "metric").select("metric", "estimate", *known, "repetitions")  # a row a metric


def sql_draws(reps: int, seed: int, units: str, key: str, columns: list[str]) -> str:
    """The draws in DuckDB: common tables ``b0 .. b2`` with ``rep``, ``w`` and the columns of every unit, from a table ``units``."""
    digit = lambda i: f"cast('0x' || substr(md5('{seed}:' || {key}), {8 * i + 1}, 8) as bigint) % {PRIME}"
    poly = reduce(lambda x, i: f"(({x}) * rep % {PRIME} + c{i})", (2, 1, 0), "c3")
    weight = " + ".join(f"(case when x >= {e} then 1 else 0 end)" for e in EDGES)
    listed = ", ".join(columns)
    return (
        f"b0 as (select {listed}, {', '.join(f'{digit(i)} as c{i}' for i in range(4))} from {units} where {key} is not null),\n"
        f"b1 as (select {listed}, rep, {poly} % {PRIME} as x from b0, range(1, {reps + 1}) t(rep)),\nb2 as (select {listed}, rep, {weight} as w from b1)"
    )
