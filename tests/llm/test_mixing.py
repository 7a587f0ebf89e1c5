import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from segloom.llm import mixing

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)]


def frames(spark, rows, targets=TARGETS):
    return (
        spark.createDataFrame([(i, s, n, 1) for i, s, n in rows], "doc_id long, source string, tokens long, part int"),
        spark.createDataFrame([(s, w, r, "x") for s, w, r in targets], "source string, target_share double, max_repeats int, demand string"),
    )


def test_shares_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaaaabcd"), rng.randint(1, 60)) for i in range(3000)] + [(9000, None, 50)]
    sizes, targets = frames(spark, rows)
    got = mixing.mix(sizes, targets).collect()
    tokens, uses = defaultdict(int), Counter()
    for r in got:
        tokens[r.source] += r.tokens
        uses[r.source, r.doc_id] += 1
    total = sum(tokens.values())
    most = {s: m for s, _, m in TARGETS}
    assert all(n <= most[s] for (s, _), n in uses.items())
    assert set(tokens) == {"a", "b", "c"}
    assert all(abs(tokens[s] / total - w) < 0.005 for s, w, _ in TARGETS)
    at = [r.position for r in got]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    supply = {s: sum(n for _, t, n in rows if t == s) for s in "abc"}
    assert total >= 0.98 * min(supply[s] * m / w for s, w, m in TARGETS)
    shares = {r.source: r for r in mixing.shares(mixing.mix(sizes, targets), targets).collect()}
    assert all(abs(shares[s].reached_share - tokens[s] / total) < 1e-9 and shares[s].most_uses <= most[s] for s in "abc")


def test_a_few_long_records_keep_the_share(spark):
    rng = random.Random(4)
    rows = [(i, "a", 20) for i in range(4000)] + [(10_000 + i, "b", n) for i, n in enumerate([9000] * 6 + [rng.randint(100, 3000) for _ in range(40)])] + [(20_000 + i, "c", 30) for i in range(600)]
    got = mixing.mix(*frames(spark, rows, [("a", 0.8, 1), ("b", 0.1, 1), ("c", 0.1, 1)])).collect()
    total = sum(r.tokens for r in got)
    by = Counter()
    for r in got:
        by[r.source] += r.tokens
    assert all(abs(by[s] / total - w) < 0.004 for s, w in (("a", 0.8), ("b", 0.1), ("c", 0.1))), by
    assert len({(r.doc_id, r["pass"]) for r in got}) == len(got)


def test_weights_over_time(spark):
    rows = [(i, "ab"[i % 2], 10 if i % 2 else 30) for i in range(4000)]
    sizes, targets = frames(spark, rows, [("a", 0.5, 1), ("b", 0.5, 9)])
    got = mixing.mix(sizes, targets, strength=0.8).collect()
    early = sum(r.tokens for r in got if r.position < 0.2 and r.source == "b") / sum(r.tokens for r in got if r.position < 0.2)
    late = sum(r.tokens for r in got if r.position > 0.8 and r.source == "b") / sum(r.tokens for r in got if r.position > 0.8)
    assert abs(early - 0.5 * (1 + 0.8 * 0.8)) < 0.05 and abs(late - 0.5 * (1 - 0.8 * 0.8)) < 0.05  # short records early


def test_tilts_are_balanced():
    w = [0.5, 0.3, 0.2]
    a = mixing.tilts(w, [10, 300, 5], 0.9)
    assert abs(sum(x * y for x, y in zip(w, a))) < 1e-12 and max(map(abs, a)) <= 1
    assert mixing.tilts([1.0], [3], 0.9) == [0.0]


@pytest.mark.parametrize("a", [-1.0, -0.4, 0.0, 0.7, 1.0])
def test_inverse(a):
    t = np.linspace(0, 1, 101)
    u = t + a * (t * t - t)
    assert np.allclose(mixing.time_of(u, np.full(101, a)), t, atol=1e-6)


def test_plans():
    supply = {"a": (100, 10), "b": (0, 0)}
    p = mixing.plan(supply, [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 1)])
    assert [(x.source, x.share, x.demand, x.passes) for x in p] == [("a", 1.0, 200.0, 2)]
    assert mixing.plan({}, [("a", 1.0, 1)]) == []
    short = mixing.plan({"a": (100, 10), "b": (100, 10)}, [("a", 0.5, 1), ("b", 0.5, 1)], total=1000)
    assert [x.demand for x in short] == [100, 100]


def test_nothing_to_mix(spark):
    sizes, targets = frames(spark, [])
    assert mixing.mix(sizes, targets).count() == 0
    assert {r.tokens for r in mixing.shares(mixing.mix(sizes, targets), targets).collect()} == {0}
    sizes, targets = frames(spark, [(1, "a", 0), (2, "z", 5)])
    assert mixing.mix(sizes, targets).count() == 0


def test_filling_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 5) for _ in range(rng.randint(0, 8))}
        room = rng.randint(0, 300)
        left, pool, want = room, [s for s, n in counts.items() for _ in range(n)], []
        while any(s <= left for s in pool):
            s = max(s for s in pool if s <= left)
            pool.remove(s)
            want.append(s)
            left -= s
        assert [s for s, n in mixing.fill(room, counts) for _ in range(n)] == want


def test_any_number_of_fillers(spark):
    """One long record that doesn't fit leaves room for many short ones; they stand where the demand for them is, at the end."""
    rows = [(i, "a", 10) for i in range(1000)] + [(5000 + i, "b", 5000) for i in range(1)] + [(6000 + i, "b", 7) for i in range(300)]
    got = mixing.mix(*frames(spark, rows, [("a", 0.9, 1), ("b", 0.1, 1)])).collect()
    by = Counter()
    for r in got:
        by[r.source] += r.tokens
    assert abs(by["b"] / sum(by.values()) - 0.1) < 0.002
    assert len({(r.doc_id, r["pass"]) for r in got}) == len(got)
