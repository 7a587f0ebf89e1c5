import random

import pytest

from segloom.operators import components as cp


@pytest.mark.parametrize(("seed", "sent"), [(0, "0"), (1, "0"), (2, "0"), (2, "1000000")])
def test_components_against_a_loop(spark, seed, sent):
    rng = random.Random(seed)
    n = [40, 400, 2000][seed]
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(i, i + 1) for i in range(n, n + 150)] + [(n * 2, n * 2 + i) for i in range(1, 90)] + [(5, 5), (None, 3)]
    part = {}
    for a, b in edges:
        if a is not None and a != b:
            part.setdefault(a, {a})
            part.setdefault(b, {b})
            both = part[a] | part[b]
            for x in both:
                part[x] = both
    spark.conf.set("spark.segloom.mostSent", sent)
    try:
        got = {r.id: r.component for r in cp.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        spark.conf.unset("spark.segloom.mostSent")
    assert got == {x: min(s) for x, s in part.items()}


def test_chunks_keep_what_is_joined():
    import pyarrow as pa

    batches = [pa.record_batch([pa.array([5, 4, 3]), pa.array([4, 3, 2])], ["u", "v"]), pa.record_batch([pa.array([9]), pa.array([5])], ["u", "v"])]
    rows = [tuple(r.values()) for b in cp._stars(("u", "v"), 3, False)(iter(batches)) for r in b.to_pylist()]
    assert rows == [(5, 2), (4, 2), (3, 2), (9, 5)]
