import random

import numpy as np
import pytest

from segloom.llm import runs

WORDS = {"Joy": "Joy", "Fear": "Fear", "Interest": "Interest"}


def brute(rows, limits):
    from segloom.functions.spelling import Vocabulary

    v, out = Vocabulary(WORDS), []
    for e, i, label, s, d in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[3], r[1])):
        last = out[-1] if out else None
        near = last and last["e"] == e and runs.label_similarity(v, last["label"], label) >= limits.similarity
        if near and (limits.gap_ms is None or s - last["end"] <= limits.gap_ms):
            last |= {"last": i, "n": last["n"] + 1, "label": label, "end": d, "top": max(last["top"], d)}
        else:
            out.append({"e": e, "first": i, "last": i, "n": 1, "label": label, "start": s, "end": d, "top": d})
    return sorted((r["e"], r["first"], r["last"], r["n"], r["start"], r["top"]) for r in out)


@pytest.mark.parametrize(("seed", "gap"), [(0, None), (1, None), (2, 5), (3, 0)])
def test_runs_against_a_loop(spark, seed, gap):
    rng = random.Random(seed)
    spell = ["Joy", "joy ", "Joyy", "Fear", "FEAR", "Interest", "Interst", "unclear", "Unclear", None]
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice(spell), s := rng.randint(0, 4000), s + rng.randint(1, 30)) for i in range([3, 500, 500, 900][seed])]
    rows += rows[:50]  # delivered again
    rng.shuffle(rows)
    limits = runs.Limits(gap_ms=gap)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "entity string, id long, label string, start_ms long, end_ms long, at string, open int")
    got = sorted((r.entity, r.first_id, r.last_id, r.events, r.start_ms, r.end_ms) for r in runs.collapse_runs(df, WORDS, limits).collect())
    assert got == brute(rows, limits)


def test_one_run_over_all_tasks(spark):
    df = spark.createDataFrame([("v", i, "Joy" if i % 3 else "joyy", i, i + 1) for i in range(2000)], "entity string, id long, label string, start_ms long, end_ms long")
    r = runs.collapse_runs(df, WORDS).collect()
    assert [(x.first_id, x.last_id, x.events, x.label) for x in r] == [(0, 1999, 2000, "Joy")]


def test_empty(spark):
    df = spark.createDataFrame([], "entity string, id long, label string, start_ms long, end_ms long")
    assert runs.collapse_runs(df, WORDS).count() == 0


LETTERS = "aaaaaaaa aaaaaaab aaaaaabb aaaaabbb aaaabbbb bbbbbbbb".split()


def greedy(labels, like, limit):
    """Agglomeration by a plain loop: again and again the most similar neighbours, the first of those that tie."""
    runs = [[x] for x in labels]
    while True:
        scores = [min(like.of(x, y) for x in a for y in b) for a, b in zip(runs, runs[1:])]
        best = max(scores, default=0)
        if best < limit:
            return [k for k, r in enumerate(runs) for _ in r]
        i = scores.index(best)
        runs[i : i + 2] = [runs[i] + runs[i + 1]]


def test_agglomeration_against_a_loop():
    from segloom.functions.spelling import Vocabulary

    like = runs.Likeness(Vocabulary({}))
    rng = random.Random(1)
    differs = 0
    for _ in range(300):
        labels = [rng.choice(LETTERS) for _ in range(rng.randint(1, 14))]
        for limit in (0.3, 0.5, 0.6, 0.7):
            want = greedy(labels, like, limit)
            got = runs.agglomerate([[x] for x in labels], like, limit)
            assert got == want
            linked = np.concatenate(([0], np.cumsum([like.of(a, b) < limit for a, b in zip(labels, labels[1:])]))).astype(int).tolist()
            differs += got != linked
    assert differs > 100  # islands of linked neighbours are something else
    assert runs.agglomerate([["x"]], like, 0.9) == [0]


@pytest.mark.parametrize(("limit", "gap"), [(0.5, None), (0.6, 6), (0.7, 2)])
def test_order_of_merges_over_tasks(spark, limit, gap):
    from segloom.functions.spelling import Vocabulary

    rng = random.Random(7)
    rows, at = [], 0
    for i in range(800):
        at += rng.randint(1, 12)
        rows.append(("hot" if i < 600 else "cold", i, rng.choice(LETTERS), at, at + rng.randint(1, 4)))
    like, want = runs.Likeness(Vocabulary({})), []
    stretch: list = []
    for r in [*rows, None]:
        if stretch and (r is None or r[0] != stretch[-1][0] or (gap is not None and r[3] - stretch[-1][4] > gap)):
            number = greedy([x[2] for x in stretch], like, limit)
            for k in dict.fromkeys(number):
                part = [x for x, n in zip(stretch, number) if n == k]
                want.append((part[0][0], part[0][1], part[-1][1], len(part)))
            stretch = []
        stretch.append(r)
    df = spark.createDataFrame(rows, "entity string, id long, label string, start_ms long, end_ms long")
    got = runs.collapse_runs(df, {}, runs.Limits(limit, gap)).collect()
    assert sorted((r.entity, r.first_id, r.last_id, r.events) for r in got) == sorted(want)


def test_limits():
    with pytest.raises(ValueError, match="similarity"):
        runs.Limits(0.0)


def test_open_stretches_of_one_task_stay_apart(spark):
    rows = [("v", i, "Joy" if i % 100 < 3 else "Fear" if i % 2 else "Interest", i, i + 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "entity string, id long, label string, start_ms long, end_ms long")
    got = [(r.first_id, r.last_id) for r in runs.collapse_runs(df, WORDS).collect() if r.events > 1]
    assert sorted(got) == [(100 * k, 100 * k + 2) for k in range(10)]
