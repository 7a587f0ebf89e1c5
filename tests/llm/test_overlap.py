import json
import random

import pytest

from segloom.llm import overlap
from segloom.llm.segment_join import segment_join


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if False else _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


@pytest.mark.parametrize(("edits", "share"), [(0, None), (1, None), (2, None), (3, None), (1, 0.25)])
def test_join_against_brute_force(spark, edits, share):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 11)))
    q = [(rng.choice("XY"), i, word()) for i in range(60)]
    b = [(rng.choice("XY"), i, word()) for i in range(60)]
    schema = "block string, id long, text string, l string, query_id int"
    got = sorted((r.query_id, r.base_id, r.distance) for r in segment_join(*(spark.createDataFrame([(*r, "clash", 0) for r in rows], schema) for rows in (q, b)), edits=edits, share=share).collect())
    want = [(i, j, d) for x, i, s in q for y, j, t in b if x == y and (d := distance(s, t)) <= (edits if share is None else int(len(s) * share))]
    assert got == sorted(want)


def test_join_of_nulls_and_nothing(spark):
    schema = "block string, id long, text string"
    a = spark.createDataFrame([(None, 1, "x"), ("b", 2, None), ("b", 3, "x")], schema)
    assert [(r.query_id, r.base_id) for r in segment_join(a, a, edits=1).collect()] == [(3, 3)]
    assert segment_join(a, a.limit(0), edits=1).count() == 0


@pytest.mark.parametrize(
    "name",
    [
        "/data/fieldcam/clips/fc_008210498.mp4", "fc_008210498", "FC_8210498", "fc%20008210498-hd.mp4?v=2", "/mnt/x/FC_008210498_COPY.mp4?v=2", "copy_of_fc_008210498", "re-fc__008210498.Mp4#t=0", "fc_008210498 - Copy.avi", "fc_008210498 (1)-hd.avi",
        "fc_000008210498.h264_1080p.avi", "store://clips/raw/fc-008210498-x265_v2.mkv", " fc_008210498(2)", "fc_008210498_final_backup", "a\\b\\fc_008210498.MOV", "fc_008210498-copy2 - Copy",
    ],
)
def test_one_clip_under_many_names(name):
    assert overlap.clip_key(name) == "fc 8210498"


@pytest.mark.parametrize(
    ("a", "b"),
    [("fc_008210498_pt1", "fc_008210498_pt2"), ("fc_008210498", "fc_008210498_pt1"), ("fc_008210498", "fc_008210499"), ("fc_008210498", "008210498"), ("arch-1993-000432081", "arch-1994-000432081"), ("nba-000132306", "nbb-000132306"), ("0udqflky", "udqflky"), ("pet_cam1_5", "pet_cam2_5"), ("old_man_01", "man_01"), ("new_york_001", "york_1"), ("orig_7_fc", "7_fc")],
)
def test_different_clips(a, b):
    assert overlap.clip_key(a) != overlap.clip_key(b)


def test_odd_names():
    assert overlap.clip_key(None) is None and overlap.clip_key("") is None and overlap.clip_key("/---.mp4") is None
    assert overlap.clip_key("backup.mp4") == "backup"
    assert overlap.clip_key("x" * 100_000 + ".mp4") == "x" * 100_000


def record(segments, i, video="v"):
    return (i, video, [{"from": "human", "value": "q"}, {"from": "gpt", "value": json.dumps({"segments": segments})}])


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def segs(reasons, shift=0.0, start="start_time", end="end_time", labels=("Joy", "Fear")):
    return [{start: i * 5.0 + (shift if i else 0), end: i * 5.0 + 5.0 + shift, "emotion": labels[i % 2], "reason": " ".join(r)} for i, r in enumerate(reasons)]


def test_content(spark):
    a, b = words(30, 1), words(25, 2)
    near = a[:10] + ["then"] + a[10:28]  # three of 55 words differ
    far = a[:15] + words(15, 9)
    train = [record(segs([a, b]), 1), record(segs([a]), 2), record(segs([b, a]), 3), (4, "v", None), (5, "v", [])]
    test = [
        record(segs([near, b]), 11), record(segs([near, b], shift=0.1, start="start", end="end"), 12), record(segs([near, b], shift=0.3), 13), record(segs([far, far]), 14), record(segs([a]), 15),
        record(segs([a, b], labels=("Fear", "Joy")), 16), record([], 17), record(segs([[], []]), 18),
    ]
    frame = lambda rows: overlap.contents(spark.createDataFrame(rows + rows[:1], "row_id long, video string, conversations array<struct<from:string,value:string>>"))
    got = sorted((r.train_row_id, r.eval_row_id) for r in overlap.same_content(frame(train), frame(test)).collect())
    assert got == [(1, 11), (1, 12)]


def test_names_in_tables(spark):
    frame = lambda rows: overlap.clip_keys(spark.createDataFrame(rows, "row_id long, name string"), "name")
    train = frame([(1, "/a/fc_0001.mp4"), (2, "/b/FC-1_copy.avi"), (3, "fc_2"), (4, None), (1, "/a/fc_0001.mp4")])
    test = frame([(11, "fc_00001 (3)"), (12, "fc_3"), (13, None)])
    assert sorted((r.train_row_id, r.eval_row_id) for r in overlap.same_name(train, test).collect()) == [(1, 11), (2, 11)]
    assert not {(r.query, r.base) for r in overlap.linked_names(train, test).collect()} - {("fc 1", "fc 1")}


def test_names_that_equality_misses(spark):
    """Separators make keys differ; the join within some edits brings them together, and the exact test keeps other clips out."""
    frame = lambda rows: overlap.clip_keys(spark.createDataFrame(rows, "row_id long, name string"), "name")
    train = frame([(1, "/a/pet_cam5_0077.mp4"), (2, "home_reel_0031.mp4"), (3, "DL004042871.mp4"), (4, "man_01"), (5, "cam1_23"), (6, "fc_12_pt1")])
    test = frame([(11, "petcam5 77"), (12, "HomeReel_31_hd"), (13, "dl_4042871"), (14, "old_man_01"), (15, "cam12_3"), (16, "fc_12_pt2"), (17, "pet cam 5_77-copy")])
    got = sorted((r.train_row_id, r.eval_row_id) for r in overlap.same_name(train, test).collect())
    assert got == [(1, 11), (1, 17), (2, 12), (3, 13)]
    equal = train.join(test.withColumnRenamed("row_id", "e"), "key")
    assert sorted((r.row_id, r.e) for r in equal.collect()) == [(3, 13)]


def test_classes_of_clips(spark):
    frame = lambda rows: overlap.clip_keys(spark.createDataFrame(rows, "row_id long, name string"), "name")
    train, test = frame([(1, "fc_1"), (2, "fc_01"), (3, "fc_2"), (4, "fc_9")]), frame([(11, "fc_1_hd"), (12, "fc_2"), (13, "fc_3")])
    a, b = words(30, 1), words(25, 2)
    content = lambda rows: overlap.contents(spark.createDataFrame(rows, "row_id long, video string, conversations array<struct<from:string,value:string>>"))
    got = overlap.clips(train, test, content([record(segs([a, b]), 3)]), content([record(segs([a, b]), 11)])).collect()
    assert sorted((r.side, r.row_id, r.name_links, r.content_links) for r in got) == [
        ("eval", 11, 2, 1), ("eval", 12, 1, 0), ("train", 1, 1, 0), ("train", 2, 1, 0), ("train", 3, 1, 1),
    ]
    assert len({r.class_id for r in got}) == 1
