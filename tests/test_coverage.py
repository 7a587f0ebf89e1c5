import random

import pytest

from segloom.operators import coverage

SCHEMA = "video_id string, start_time double, end_time double, entity string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(v, s, e, "clash", 7) for v, s, e in rows], SCHEMA)


def brute(rows, slack):
    by = {}
    for v, s, e in rows:
        if v is None or s is None or e is None or s != s or e != e:
            continue
        a, b = round(s * 1000), round(e * 1000)
        if b > a:
            by.setdefault(v, []).append((a, b))
    out = set()
    for v, spans in by.items():
        cur = None
        for a, b in sorted(spans):
            if cur and a <= cur[1] + slack:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    out.add((v, *cur))
                cur = [a, b]
        out.add((v, *cur))
    return out


def found(spark, rows, slack=100):
    p = coverage.periods(coverage.usable(frame(spark, rows), "video_id", "start_time", "end_time"), slack)
    return p


@pytest.mark.parametrize("seed", range(4))
def test_periods_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(rng.choice([1, 30, 400])):
        v = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        s = rng.choice([None, float("nan"), round(rng.uniform(0, 200), 3)]) if rng.random() < 0.1 else round(rng.uniform(0, 200), 3)
        length = rng.choice([0, -1, 0.05, 0.5, 3, 60])
        rows.append((v, s, None if s is None else s + length))
    rows += rows[:20]
    got = {(r.entity, r.start_ms, r.end_ms) for r in found(spark, rows).collect()}
    assert got == brute(rows, 100)


def test_one_interval_over_all_tasks(spark):
    rows = [("x", 0.0, 1000.0)] + [("x", float(i), i + 0.5) for i in range(500)] + [("x", 1000.05, 1001.0), ("x", 2000.0, 2001.0)]
    got = sorted((r.start_ms, r.end_ms, r.next_start, r.first) for r in found(spark, rows).collect())
    assert got == [(0, 1001000, 2000000, True), (2000000, 2001000, None, False)]


def test_gaps(spark):
    rows = [("a", 0.2, 1.0), ("a", 2.0, 3.0), ("b", 0.05, 1.0), ("c", 1.0, 2.0)]
    limits = spark.createDataFrame([("a", 4000), ("b", 1050), (None, 9), ("c", 0), ("d", 5000)], "entity string, limit_ms long")
    p = found(spark, rows)
    got = sorted((r.entity, r.kind, r.start_ms, r.end_ms) for r in coverage.periods_and_gaps(p, limits, 100).collect())
    assert got == [
        ("a", "gap", 0, 200), ("a", "gap", 1000, 2000), ("a", "gap", 3000, 4000), ("a", "period", 200, 1000), ("a", "period", 2000, 3000),
        ("b", "period", 50, 1000), ("c", "gap", 0, 1000), ("c", "period", 1000, 2000),
    ]


def test_empty(spark):
    assert found(spark, []).count() == 0
