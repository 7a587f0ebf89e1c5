import itertools
import random

import pytest
from pyspark.sql import functions as F

from segloom.operators import segments as sg

LIST = "id int, duration double, segments array<struct<start_time:double,end_time:double,emotion:string,reason:string>>"


def lists(spark, *rows):
    return spark.createDataFrame([(i, d, s) for i, (d, s) in enumerate(rows)], LIST)


def seg(a, b, label="Joy", reason="r"):
    return (a, b, label, reason)


def tiles(spark, duration, segments):
    r = lists(spark, (duration, segments)).select(sg.tile(F.col("segments"), F.col("duration")).alias("x")).first()
    return [(round(x.start_time, 6), round(x.end_time, 6), x.emotion) for x in r.x]


def test_tiling_cases(spark):
    nan = float("nan")
    assert tiles(spark, 10.0, []) == [(0.0, 10.0, None)]
    assert tiles(spark, 0.0, [seg(0.0, 1.0)]) == []
    assert tiles(spark, None, [seg(0.0, 1.0)]) == []
    assert tiles(spark, 10.0, [seg(4.0, 6.0, "B"), seg(0.5, 3.0, "A"), seg(7.0, 7.0), seg(None, 2.0), seg(nan, 3.0)]) == [(0.0, 3.0, "A"), (3.0, 10.0, "B")]
    assert tiles(spark, 5.0, [seg(-3.0, 2.0), seg(1.0, 99.0)]) == [(0.0, 2.0, "Joy"), (2.0, 5.0, "Joy")]


@pytest.mark.parametrize("seed", range(3))
def test_tiling_covers_the_clip(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.uniform(3, 50), 1), [seg(round(rng.uniform(-1, 50), 1), round(rng.uniform(0, 60), 1), rng.choice("AB")) for _ in range(rng.randint(0, 8))]) for _ in range(40)]
    for r in lists(spark, *rows).select("duration", sg.tile(F.col("segments"), F.col("duration")).alias("x")).collect():
        ends = [(x.start_time, x.end_time) for x in r.x]
        assert ends[0][0] == 0 and ends[-1][1] == r.duration
        assert all(a[1] == b[0] for a, b in itertools.pairwise(ends))


def test_merge_equal(spark):
    rows = [seg(0.0, 1.0, "A", "one"), seg(1.0, 2.0, "A", "one"), seg(2.0, 3.0, "A", "two"), seg(3.0, 4.0, "B", None), seg(4.0, 5.0, "B", "x"), seg(5.0, 6.0, None, "n"), seg(6.0, 7.0, None, "n")]
    r = lists(spark, (9.0, rows), (9.0, [])).orderBy("id").select(sg.merge_equal(F.col("segments")).alias("x")).collect()
    assert [(x.start_time, x.end_time, x.emotion, x.reason) for x in r[0].x] == [(0.0, 3.0, "A", "one two"), (3.0, 5.0, "B", "x"), (5.0, 7.0, None, "n")]
    assert r[1].x == []


def test_repair_label(spark):
    words = ["Awkwardness", "Joy", "Interest"]
    df = spark.createDataFrame([("Joy",), ("joyful",), ("INTEREST",), ("",), (None,), ("zzz",)], "l string")
    assert [r.x for r in df.select(sg.repair_label(F.col("l"), words).alias("x")).collect()] == ["Joy", "Joy", "Interest", "Awkwardness", "Awkwardness", "Interest"]


@pytest.mark.parametrize(
    ("segments", "fault"),
    [
        ([seg(0.0, 4.0, "Joy"), seg(4.0, 10.0, "Fear")], None), ([], "empty"), ([seg(0.0, 0.0, "Joy")], "order"), ([seg(None, 1.0, "Joy")], "order"), ([seg(0.0, 4.0, "Joy"), seg(4.3, 10.0, "Fear")], "continuity"),
        ([seg(0.0, 10.0, "Nope")], "label"), ([seg(0.0, 10.0, None)], "label"), ([seg(0.0, 10.0, "Joy", " ")], "reason"), ([seg(0.0, 4.0, "Joy"), seg(4.0, 10.0, "Joy")], "repeated"), ([seg(0.0, 9.0, "Joy")], "coverage"),
        ([seg(1.0, 10.0, "Joy")], "coverage"), ([seg(0.0, 4.12, "Joy"), seg(4.12, 10.0, "Fear")], "decimals"),
    ],
)
def test_first_fault(spark, segments, fault):
    r = lists(spark, (10.0, segments)).select(sg.first_fault(F.col("segments"), F.col("duration"), ["Joy", "Fear"], 0.051, True).alias("x")).first()
    assert r.x == fault


def test_islands(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x"), ("b", 1, "x")], "entity string, s long, label string").withColumn("e", F.col("s") + 1).withColumn("id", F.col("s")).withColumn("one", F.lit(1))
    got = sorted(((r.entity, r.island, r.label or "", r.n, r.s, r.e) for r in sg.islands(df, "entity", ["s", "id"], "label").collect()))
    assert got == [("a", 1, "x", 2, 1, 3), ("a", 2, "", 2, 3, 5), ("a", 3, "x", 1, 5, 6), ("b", 1, "x", 1, 1, 2)]


def test_best_match_takes_the_first_on_ties(spark):
    a = spark.createDataFrame([("v", 0, 0, 10), ("v", 1, 50, 60), ("w", 0, 0, 5)], "entity string, i int, s long, e long")
    b = spark.createDataFrame([("v", 0, 0, 5), ("v", 1, 5, 10), ("v", 2, 4, 9)], "entity string, j int, s2 long, e2 long")
    got = {(r.entity, r.i): (r.j, round(r.iou, 3)) for r in sg.best_match(a, b, 7).collect()}
    assert got == {("v", 0): (0, 0.5), ("v", 1): (0, 0.0), ("w", 0): (None, 0.0)}


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    make = lambda: [(rng.choice("ab"), i, s := rng.randint(0, 300), s + rng.randint(0, 60)) for i in range(80)]
    x, y = make(), make()
    a, b = spark.createDataFrame(x, "entity string, i int, s long, e long"), spark.createDataFrame(y, "entity string, j int, s2 long, e2 long")
    got = sorted((r.i, r.j) for r in sg.overlapping(a, b, 25).collect())
    assert got == sorted((p[1], q[1]) for p in x for q in y if p[0] == q[0] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3])


def test_matching_is_maximum(spark):
    rng = random.Random(3)
    edges = {(g, rng.randint(0, 4), rng.randint(0, 4)) for g in range(12) for _ in range(rng.randint(1, 8))}

    def best(pairs):
        return max((n for n in range(len(pairs) + 1) for c in itertools.combinations(pairs, n) if len({i for i, _ in c}) == n == len({j for _, j in c})), default=0)

    df = spark.createDataFrame([(f"g{g}", i, j) for g, i, j in edges], "entity string, i int, j int")
    got = {r.entity: r.pairs for r in sg.matched(df).collect()}
    assert got == {f"g{g}": best([(i, j) for h, i, j in edges if h == g]) for g in {e[0] for e in edges}}


def test_snap(spark):
    rows = spark.createDataFrame([("a", 0, 100), ("a", 1, 1000), ("b", 0, 5)], "entity string, idx int, t long")
    cuts = spark.createDataFrame([("a", 90), ("a", 110), ("a", 1051)], "entity string, c long")
    assert sorted((r.entity, r.idx, r.aligned, r.delta) for r in sg.snap(rows, cuts, 50).collect()) == [("a", 0, 90, -10), ("a", 1, 1000, 0), ("b", 0, 5, 0)]
