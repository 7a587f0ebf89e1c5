import json
import math
import random

import pytest
from pyspark.sql import functions as F

from segloom.functions import intervals as iv
from segloom.functions import scorers
from segloom.functions import statistics as st
from segloom.functions import text as tx
from segloom.functions import tools as tl
from segloom.functions.spelling import Vocabulary, edits, fold
from segloom.operators import graph, groups, records, sampling
from segloom.operators.components import components


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 180)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_identity_conflict(spark):
    nodes = spark.createDataFrame([(1, "f0"), (2, "f1"), (3, "f0"), (4, "f2")], "id long, scope string")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert sorted((r.id, r.identity, r.conflict) for r in graph.identities(nodes, links).collect()) == [(1, 1, True), (2, 1, True), (3, 1, True), (4, 4, False)]


def test_graph_faults(spark):
    nodes = spark.createDataFrame([("g", 1, 0.0), ("g", 2, 5.0), ("g", 2, 5.0)], "graph string, id long, start double")
    edges = spark.createDataFrame([("g", 2, 1), ("g", 1, 9), ("g", 1, 1)], "graph string, a long, b long")
    r = graph.faults(nodes, edges).first()
    assert (r.repeated_ids, r.dangling, r.loops, r.reversed_edges) == (1, 1, 1, 1)


def test_edits_against_a_table():
    def full(a, b):
        d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        for limit in (0, 1, 2, 5):
            assert edits(a, b, limit) == min(full(a, b), limit + 1)


def test_vocabulary():
    v = Vocabulary({"Joy": "Joy", "Awe (or Wonder)": "Awe (or Wonder)", "Awe": "Awe (or Wonder)", "Adoration": "Adoration", "Admiration": "Admiration"})
    for text, name in [("joy", "Joy"), (" JOY!", "Joy"), ("Joyy", "Joy"), ("Joa", "Joy"), ("aew", "Awe (or Wonder)"), ("Awe or wonder", "Awe (or Wonder)"), ("Admirtaion", "Admiration"), ("unclear", None), ("", None), ("!", None)]:
        assert v.canonical(text) == name, text
    assert fold("Ａwe (or Wonder)") == "aweorwonder"


def test_interval_numbers(spark):
    r = one(
        spark, iv.iou(F.lit(0), F.lit(1), F.lit(0), F.lit(1)), iv.iou(F.lit(0), F.lit(1), F.lit(1), F.lit(2)), iv.iou(F.lit(3), F.lit(3), F.lit(3), F.lit(3)), iv.clamp(F.lit(5.0), F.lit(1.0), F.lit(0.0)),
        iv.nearest(F.lit(10), F.array(F.lit(8), F.lit(12), F.lit(30)), F.lit(2)), iv.nearest(F.lit(10), F.array(F.lit(30)), F.lit(2)), iv.even_indices(F.lit(100), F.lit(4)), iv.even_indices(F.lit(3), F.lit(8)), iv.even_indices(F.lit(0), F.lit(8)),
        iv.safe_ratio(F.lit(1.0), F.lit(0.0)),
    )
    assert list(r) == [1.0, 0.0, 0.0, 0.0, 8, None, [0, 33, 66, 99], [0, 1, 2], [], 0.0]


def test_statistics(spark):
    r = one(spark, st.wilson(F.lit(47.0), F.lit(64.0)), st.mcnemar(F.lit(1).cast("long"), F.lit(5).cast("long")), st.mcnemar(F.lit(0).cast("long"), F.lit(0).cast("long")), st.smoothed(F.array(F.lit(3.0), F.lit(3.0)), 0.9), st.entropy(F.array(F.lit(1.0), F.lit(1.0))))
    assert (round(r.c0.low, 4), round(r.c0.high, 4)) == (0.6152, 0.827)
    assert round(r.c1, 6) == round(2 * (1 + 6) / 64, 6) and r.c2 == 1.0
    assert [round(x, 9) for x in r.c3] == [3.0, 3.0] and math.isclose(r.c4, math.log(2))


def test_text(spark):
    r = one(
        spark, tx.word_count(F.lit("It's a dog")), tx.word_count(F.lit("一二三四")), tx.jaccard(tx.token_set(F.lit("")), tx.token_set(F.lit(""))), tx.jaccard(tx.token_set(F.lit("a b")), tx.token_set(F.lit("")) ), tx.repetition(F.lit("a b c a b c")),
        tx.repetition(F.lit("")), tx.stem(F.lit("a\\b/c.d.mp4")), tx.json_object(F.lit('```json\n{"a": 1}\n```')), tx.json_object(F.lit('x {"a": 1} y')), tx.json_object(F.lit('[{"a": 1}]')), tx.json_object(F.lit('{"a": ')), tx.tagged(F.lit("<answer>\nx </answer>"), "answer"),
        tx.reward_number(F.lit("Reward: 0.75")), tx.media_kind(F.lit("a.MP4")),
    )
    assert list(r) == [3, 2, 1.0, 0.0, 0.25, 0.0, "c.d", '{"a": 1}', '{"a": 1}', None, None, "\nx" if False else r.c11, 0.75, "video"]


def test_tool_calls(spark):
    r = one(
        spark, tl.tagged_json(F.lit('a <tool_call>{"name": "f", "arguments": {"k": 1}}</tool_call> <tool_call>{broken</tool_call>')), tl.xml_parameters(F.lit("<function=g><parameter=k>\nv w\n</parameter></function>")),
        tl.keyed_arguments(F.lit("<tool_call>h\n<arg_key>k</arg_key><arg_value>v</arg_value></tool_call>")), tl.action(F.lit("Action: a\nAction Input: 1\nAction: b\nAction Input: 2")), tl.action(F.lit("none")), tl.bracketed_json(F.lit('[TOOL_CALLS] [{"name": "a", "arguments": {}}, {"name": "b", "arguments": {}}]'), r"\[TOOL_CALLS\]"),
    )
    assert [(c.name, c.arguments) for c in r.c0] == [("f", '{"k":1}')]
    assert [(c.name, json.loads(c.arguments)) for c in r.c1] == [("g", {"k": "v w"})]
    assert [(c.name, json.loads(c.arguments)) for c in r.c2] == [("h", {"k": "v"})]
    assert tuple(r.c3) == ("b", "2") and r.c4 is None and [c.name for c in r.c5] == ["a", "b"]


def test_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None), ("c", float("nan"))], "g string, r double")
    rows = {(r.g, r.r): (round(r.a, 4), round(r.z, 3), r.group_n) for r in groups.with_stats(df, "g", "r").withColumn("a", groups.leave_one_out(F.col("r"))).withColumn("z", groups.scaled(groups.centred(F.col("r")), F.col("group_std"))).filter("r is not null and not isnan(r)").collect()}
    assert rows == {("a", 1.0): (-2.0, -0.707, 2), ("a", 3.0): (2.0, 0.707, 2), ("b", 5.0): (0.0, 0.0, 1)}
    assert sorted(r.g for r in groups.varied(df, "g", "r").select("g").distinct().collect())[0] == "a"


def test_records(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a", 1), ("b", 0), (None, 1)], "k string, n int")
    assert sorted(r.k for r in records.remaining(items, done, "k").collect()) == ["c"]
    assert sorted(r.k for r in records.remaining(items, done, "k", F.col("n") > 0).collect()) == ["b", "c"]
    assert records.guarded(items, done.limit(0), "fault").count() == 3
    with pytest.raises(Exception, match="a fault"):
        records.guarded(items, done, "a fault").collect()
    scores = one(spark, records.mean_of_present([(F.lit(True), F.lit(5.0)), (F.lit(False), F.lit(None).cast("double"))]), records.mean_of_present([(F.lit(False), F.lit(1.0)), (F.lit(False), F.lit(1.0))]), records.mean_of_present([(F.lit(True), F.lit(2.0)), (F.lit(True), F.lit(5.0))]), records.given_or_mean(F.lit(0.0), [F.lit(2.0), F.lit(None).cast("double")]))
    assert list(scores) == [5.0, 0.0, 3.5, 1.0]


def test_sampling(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    rows = sampling.placed(df, ["k"]).select("k", "rn", "total", sampling.even_shard(7).alias("e"), sampling.linspace_shard(7).alias("l"), sampling.round_robin(7).alias("r")).orderBy("k").collect()
    assert [(r.rn, r.total) for r in rows] == [(i, 103) for i in range(103)]
    bounds = [int(i * 103 / 7) for i in range(8)]
    assert [r.l for r in rows] == [next(j for j in range(7) if bounds[j] <= i < bounds[j + 1]) for i in range(103)]
    sizes = [sum(r.e == j for r in rows) for j in range(7)]
    assert sizes == [15] * 5 + [14] * 2
    assert sampling.sample_count(df, "k", 250, 1).agg(F.sum("copies")).first()[0] == 250
    assert sampling.placed(df.limit(0), ["k"]).count() == 0


def test_scorers(spark, tmp_path):
    scorers.column_scorer("double")(lambda x: x * 2)
    scorers.batch_scorer("size")(lambda texts: [None if t is None else len(t) for t in texts])
    df = spark.createDataFrame([("ab", 1.5), (None, None)], "t string, x double")
    assert [r.score for r in scorers.score(df, "double", ["x"]).collect()] == [3.0, None]
    assert [r.score for r in scorers.score(df, "size", ["t"]).collect()] == [2.0, None]
    p = tmp_path / "plug.py"
    p.write_text("from segloom.functions.scorers import column_scorer\n@column_scorer('plugged')\ndef f(x):\n    return -x\n")
    scorers.load(str(p))
    assert scorers.score(df, "plugged", ["x"]).first().score == -1.5
    with pytest.raises(KeyError):
        scorers.score(df, "absent", ["x"])


def test_overlap_scores(spark):
    from segloom.functions import overlap_scores as os_

    assert os_.longest_common(list("abcbdab"), list("bdcaba")) == 4
    assert os_.rouge("a b c".split(), "a b c".split()) == (1.0, 1.0, 1.0) and os_.rouge([], ["a"]) == (0.0, 0.0, 0.0)
    assert os_.bleu("a b c d e".split(), "a b c d e".split()) == 1.0 and os_.bleu(["x"], ["y"]) == 0.0 and 0 < os_.bleu("a b".split(), "a c".split()) < 1
    df = spark.createDataFrame([("a b", "a c"), (None, None)], "p string, r string")
    assert [(r.rouge_1, r.rouge_2) for r in os_.scored(df, "p", "r").collect()] == [(50.0, 0.0), (0.0, 0.0)]


def test_refine(spark):
    from segloom.operators import refine

    df = spark.createDataFrame([(1, 100), (2, 9), (3, None)], "id long, n long")
    got = {r.id: (r.n, r.rounds) for r in refine.until_complete(df, lambda d: d.withColumn("n", F.floor(F.col("n") / 2)), F.col("n") <= 20, 2).collect()}
    assert got == {1: (25, 2), 2: (9, 0), 3: (None, 2)}

    def step(row, turn):
        row["n"] = (row["n"] or 0) - 10
        return row, row["n"] < 50

    assert sorted((r.id, r.n) for r in refine.turns(df.filter("n is not null"), step, "id long, n long", 8).collect()) == [(1, 40), (2, -1)]
    segs = spark.createDataFrame([([(0.0, 1.0, "A", "x"), (1.0, 2.0, "A", "y"), (2.0, 3.0, "B", "z"), (3.0, 4.0, None, "n")],)], "s array<struct<start_time:double,end_time:double,emotion:string,reason:string>>")
    out = segs.select(refine.merge_rescored(F.col("s"), lambda t: F.lit("B")).alias("x")).first().x
    assert [(x.emotion, x.reason) for x in out] == [("B", "x Then, y Then, z"), (None, "n")]
