import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.functions import statistics as st
from segloom.operators import resampling as rs


def draws(key, repetitions, seed):
    digest = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
    c = [int(digest[8 * i : 8 * i + 8], 16) % rs.PRIME for i in range(4)]
    return [sum(((c[3] * r + c[2]) * r + c[1]) % rs.PRIME * r % rs.PRIME + c[0] - rs.PRIME * (((((c[3] * r + c[2]) * r + c[1]) % rs.PRIME) * r % rs.PRIME + c[0]) >= rs.PRIME) >= e for e in rs.EDGES) for r in range(1, repetitions + 1)]


def test_sums_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"u{i}", rng.random(), rng.randint(0, 9), "clash") for i in range(700)] + [(None, 1.0, 1, "x"), ("nulls", None, None, "x")]
    df = spark.createDataFrame(rows, "key string, a double, b int, rep string").repartition(3)
    got = {r.rep: (r.a, r.b) for r in rs.resampled(df, "key", ["a", "b"], 40, 5).collect()}
    for r in (1, 2, 17, 40):
        w = {k: draws(k, 40, 5)[r - 1] for k, *_ in rows if k}
        assert abs(got[r][0] - sum(w[k] * (a or 0) for k, a, *_ in rows if k)) < 1e-6 and got[r][1] == sum(w[k] * (b or 0) for k, _, b, _ in rows if k)


def test_draws_are_poisson():
    w = np.array([draws(i, 300, 3) for i in range(300)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs((w == 0).mean() - math.exp(-1)) < 0.01 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2


def test_intervals_cover(spark):
    """The interval of a mean is about as wide as the normal one, and a paired difference of equal arms is nil."""
    rng = random.Random(2)
    rows = [(i, float(rng.random() < 0.3), 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "key long, hit double, n int")
    got = {r.metric: r for r in rs.intervals(df, "key", {"rate": F.expr("hit / n"), "nil": F.expr("hit / n - hit / n")}, ["hit", "n"], 800).collect()}
    p = sum(r[1] for r in rows) / 2000
    half = 1.96 * math.sqrt(p * (1 - p) / 2000)
    r = got["rate"]
    assert abs(r.estimate - p) < 1e-9 and abs((r.high_95 - r.low_95) / 2 / half - 1) < 0.15 and r.low_95 < r.low_90 < p < r.high_90 < r.high_95
    assert (got["nil"].low_95, got["nil"].high_95) == (0, 0)


def test_no_units(spark):
    df = spark.createDataFrame([], "key long, hit double")
    assert rs.resampled(df, "key", ["hit"], 10, 1).count() == 0


@pytest.mark.parametrize(("k", "n", "p"), [(0, 5, 0.05), (3, 20, 0.05), (20, 20, 0.5), (7, 300, 0.05), (0, 0, 0.05)])
def test_binomial(spark, k, n, p):
    want = None if n == 0 else min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))
    got = spark.range(1).select(st.binomial_upper(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
    assert got is None if want is None else abs(got - want) < 1e-9
