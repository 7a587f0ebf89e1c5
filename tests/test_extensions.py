import asyncio
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.functions import media, scorers
from segloom.operators import extensions as ex
from segloom.operators import graph


def test_metric_is_merged_over_tasks(spark):
    df = spark.createDataFrame([(float(i) if i % 5 else None, "x") for i in range(1000)], "v double, state string").repartition(7)
    got = {r.name: r.value for r in ex.evaluated(df, lambda: ex.Mean("v"), ["v"], fan=2).collect()}
    kept = [i for i in range(1000) if i % 5]
    assert got["n"] == 800 and abs(got["mean"] - sum(kept) / 800) < 1e-9
    assert ex.evaluated(df.limit(0), lambda: ex.Mean("v"), ["v"]).count() == 0


def test_async_scorer_keeps_the_order(spark):
    @scorers.async_scorer("slow first", at_once=8)
    async def slow_first(x):
        await asyncio.sleep(0.02 if x % 10 == 0 else 0)
        return x * 2

    df = spark.createDataFrame([(i,) for i in range(100)], "x long")
    assert all(r.score == 2 * r.x for r in scorers.score(df, "slow first", ["x"]).collect())


def test_rows_are_played(spark):
    class Counter:
        def reset(self, row):
            self.left = row["n"]
            return self.left

        def step(self, action):
            self.left -= action
            return self.left, float(action), self.left <= 0

        def close(self):
            self.left = None

    df = spark.createDataFrame([(1, 3), (2, 0), (3, 50)], "id long, n long")
    got = sorted((r.id, r.step, r.observation, r.done) for r in ex.played(df, "id", Counter, lambda seen, past: 1 + len(past), 4).collect())
    assert got == [(1, 0, "2", False), (1, 1, "0", True), (2, 0, "-1", True), (3, 0, "49", False), (3, 1, "47", False), (3, 2, "44", False), (3, 3, "40", False)]


def test_rows_make_rows(spark):
    df = spark.createDataFrame([(1, 2), (2, 0)], "id long, n long")
    got = ex.grown(df, lambda r: ((r["id"], k) for k in range(r["n"])), "id long, k long").collect()
    assert sorted((r.id, r.k) for r in got) == [(1, 0), (1, 1)]


def test_merges_within_a_scope_are_refused(spark):
    nodes = spark.createDataFrame([(1, "f0"), (2, "f1"), (3, "f0"), (4, "f2"), (9, None)], "id long, scope string")
    links = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (3, 4, 2), (1, 2, 3)], "a long, b long, rank long")
    got = {r.id: (r.identity, r.refused) for r in graph.refusing(nodes, links).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (3, 0), 4: (3, 0), 9: (9, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_refusing_against_a_loop(spark, seed):
    rng = random.Random(seed)
    scope = {i: rng.randint(0, 3) for i in range(60)}
    links = sorted({(k, rng.randrange(60), rng.randrange(60)) for k in range(70)})
    group = {i: {i} for i in scope}
    for _, a, b in links:
        if group[a] is not group[b] and not {scope[x] for x in group[a]} & {scope[x] for x in group[b]}:
            both = group[a] | group[b]
            for x in both:
                group[x] = both
    df = graph.refusing(spark.createDataFrame(list(scope.items()), "id long, scope long"), spark.createDataFrame([(a, b, k) for k, a, b in links], "a long, b long, rank long"))
    assert {r.id: r.identity for r in df.collect()} == {i: min(s) for i, s in group.items()}


def test_media_numbers(spark):
    row = spark.range(1).select(
        media.fitted(F.lit(1080), F.lit(1920), 28).alias("a"), media.fitted(F.lit(10), F.lit(5000), 28).alias("b"), media.frame_count(F.lit(300), F.lit(30.0)).alias("c"), media.frame_count(F.lit(1), F.lit(30.0)).alias("d"),
        media.average_bits(F.array(*map(F.lit, (1.0, 9.0, 5.0, 5.0)))).alias("e"), media.bhattacharyya(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("f"),
        media.bhattacharyya(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(6.0))).alias("g"), media.steps(F.lit(5), 16, 2.5).alias("h"),
    ).first()
    assert tuple(row.a) == (1092, 1932) and row.b is None and row.c == 20 and row.d is None and row.e == "0100" and row.f == 1 and abs(row.g) < 1e-7 and row.h == 3


def test_soft_f1(spark):
    rows = [({"a": "1", "b": "2"}, {"a": "1", "c": "2"}), ({}, {}), ({"a": "1"}, {}), ({"a": "1"}, {"a": "2"})]
    got = [r.x for r in spark.createDataFrame(rows, "r map<string,string>, c map<string,string>").select(media.soft_f1(F.col("r"), F.col("c")).alias("x")).collect()]
    assert np.allclose(got, [0.5, 1.0, 0.0, 0.5])
