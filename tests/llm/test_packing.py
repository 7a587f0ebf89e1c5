import random
from collections import defaultdict

import pytest

from segloom.llm import packing
from segloom.llm.tokens import RANKS, encoding, sizes


def check(rows, items, capacities):
    filled, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        filled[r.container_kind, r.container_id] += r.tokens
        pieces[r.container_kind, r.doc_id].append((r.piece, r.first_token, r.tokens))
    for (kind, _), n in filled.items():
        assert n <= capacities[kind]
    for kind, cap in capacities.items():
        for doc, n in items.items():
            got = sorted(pieces[kind, doc])
            assert len(got) == max(1, -(-n // cap)), (kind, doc, n, got)
            assert got[0][1] == 0 and sum(t for _, _, t in got) == n and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    return filled


@pytest.mark.parametrize("seed", range(3))
def test_every_item_once_and_no_overflow(spark, seed):
    rng = random.Random(seed)
    items = {i: rng.choice([0, 1, 99, 100, 101, 250, rng.randint(1, 100)]) for i in range([0, 7, 600][seed])}
    caps = {"small": 100, "large": 1000}
    df = spark.createDataFrame([(i, n, "clash") for i, n in items.items()], "doc_id long, tokens long, open string")
    filled = check(packing.pack(df, caps, most=8).collect(), items, caps)
    if seed == 2:
        for kind, cap in caps.items():
            used = [n for (k, _), n in filled.items() if k == kind]
            assert sum(used) / (cap * len(used)) > 0.9


def test_windows():
    w = packing.Windows(10, 2, "x")
    assert [w.place(n) for n in (6, 7, 3, 4, 9, 1)] == [(0, None), (1, None), (1, None), (0, None), (2, None), (2, None)]
    assert [w.place(n) for n in (5, 8, 6)] == [(3, None), (4, None), (5, 4)]  # the fullest is closed


def test_bad_capacity(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 1)], "doc_id long, tokens long"), {"x": 0})


def test_sizes(spark):
    texts = ["", "a b c", "é" * 1000, "x " * 60_000, None]
    df = spark.createDataFrame([(i, "s", t, 5) for i, t in enumerate(texts)] + [(None, "s", "x", 5), (1, "s", "a b c", 5)], "doc_id long, source string, text string, tokens int")
    got = {r.doc_id: r.tokens for r in sizes(df, RANKS).collect()}
    assert got == {i: len(encoding(RANKS).encode_ordinary(t)) for i, t in enumerate(texts) if t is not None} and got[0] == 0


def test_leftovers_go_up_a_tree(spark):
    rng = random.Random(9)
    items = {i: rng.randint(1, 90) for i in range(3000)}
    caps = {"small": 100, "large": 1000}
    df = spark.createDataFrame(list(items.items()), "doc_id long, tokens long").repartition(4)
    for taken in (40, 100_000):
        packed = packing.pack(df, caps, most=32, taken=taken)
        filled = check(packed.collect(), items, caps)
        for kind, cap in caps.items():
            used = [n for (k, _), n in filled.items() if k == kind]
            assert sum(used) / (cap * len(used)) > 0.9, (taken, kind)
        assert [r.cases for r in packing.violations(packed, df, caps).collect()] == [0, 0, 0]


def test_violations_are_seen(spark):
    df = spark.createDataFrame([(1, 60), (2, 70), (3, 30)], "doc_id long, tokens long")
    bad = spark.createDataFrame([("x", "a", 1, 0, 0, 60), ("x", "a", 2, 0, 0, 70), ("x", "b", 4, 0, 0, 5)], "container_kind string, container_id string, doc_id long, piece int, first_token long, tokens long")
    assert {r.rule: r.cases for r in packing.violations(bad, df, {"x": 100}).collect()} == {"over capacity": 1, "not whole": 2, "split for nothing": 0}
