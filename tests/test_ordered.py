import random

import pytest

from segloom.operators.ordered import scan


@pytest.mark.parametrize("seed", range(4))
def test_scan_against_a_loop(spark, seed):
    rng = random.Random(seed)
    n = [0, 1, 60, 900][seed]
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.randint(-3, 9) if rng.random() < 0.9 else None, rng.choice(["x", "y", None])) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "entity string, k long, v long, label string")
    got = {(r.entity, r.k): (r.prev_label, r.prev_k, r.run_v, r.top_v) for r in scan(df, "entity", ["k"], lags=["label", "k"], sums=["v"], tops=["v"]).collect()}
    want, state = {}, {}
    for e, k, v, label in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        before = state.get(e, (None, None, 0, None))
        total, top = before[2] + (v or 0), max((x for x in (before[3], v) if x is not None), default=None)
        want[(e, k)] = (before[0], before[1], total, top)
        state[e] = (label, k, total, top)
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_smoothing_against_a_loop(spark, n):
    from segloom.operators.ordered import smoothed

    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.uniform(-5, 5) if rng.random() < 0.9 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "entity string, k long, v double")
    got = {(r.entity, r.k): r.smooth for r in smoothed(df, "entity", ["k"], "v", 0.8).collect()}
    state, want = {}, {}
    for e, k, v in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        y, m = state.get(e, (0.0, 0))
        if v is not None:
            y, m = 0.8 * y + 0.2 * v, m + 1
        state[e] = (y, m)
        want[(e, k)] = y / (1 - 0.8**m) if m else None
    assert got.keys() == want.keys()
    assert all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) < 1e-9) for k, a in got.items())
