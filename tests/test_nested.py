import json

import pytest

from segloom.functions.embedded_json import find_value
from segloom.operators import nested

SEG = {"segments": [{"a": 1, "candidate_pairs": [{"emotion": "x"}, {"emotion": "y"}]}, {"a": 2}]}
TEXT = json.dumps(SEG)


@pytest.mark.parametrize(
    "text",
    [TEXT, f"```json\n{TEXT}\n```", f"Here is the timeline:\n{TEXT}", json.dumps(TEXT), json.dumps(json.dumps(TEXT)), f"{TEXT}\n\nThat is all.", f"{TEXT}<|end|>", f"\n {TEXT}"],
)
def test_value_is_found(text):
    assert find_value(text) == SEG


@pytest.mark.parametrize("text", [None, "", "no JSON", TEXT[:-3], f"```json\n{TEXT[:40]}", json.dumps(TEXT)[:-9], '"just a string"', "a [b] c", "[" * 50_000])
def test_no_value(text):
    assert find_value(text) is None


def rows(spark, values):
    df = spark.createDataFrame([(i, [{"from": "human", "value": "q"}, {"from": "gpt", "value": v}], "x") for i, v in enumerate(values)], "row_id long, conversations array<struct<from:string,value:string>>, dewey string")
    return nested.nodes(nested.turns(df))


def test_tables_and_links(spark):
    n = rows(spark, [TEXT, json.dumps({"result": {"version": 1, **SEG}}), json.dumps(SEG["segments"]), TEXT[:-2], None, ""])
    segments = sorted((r.row_id, r.turn_no, r.segment_no) for r in nested.segment_table(n).collect())
    pairs = sorted((r.row_id, r.segment_no, r.pair_no) for r in nested.pair_table(n).collect())
    assert segments == [(i, 1, k) for i in range(3) for k in range(2)]
    assert pairs == [(i, 0, k) for i in range(3) for k in range(2)]


def test_parent_is_a_prefix(spark):
    n = rows(spark, [TEXT]).cache()
    own = {tuple(r.dewey) for r in nested.segment_table(n).collect()}
    for r in nested.pair_table(n).collect():
        assert tuple(r.parent_dewey) in own and r.dewey[: len(r.parent_dewey)] == r.parent_dewey


def test_lists_of_other_kinds(spark):
    n = rows(spark, [json.dumps({"segments": [1, None, "x", [2]]}), json.dumps({"segments": {}}), json.dumps({"segments": [{"candidate_pairs": None}, {"candidate_pairs": [3, {}]}]})])
    assert nested.segment_table(n).filter("row_id = 0").count() == 4
    assert nested.segment_table(n).filter("row_id = 1").count() == 0
    assert [(r.segment_no, r.pair_no) for r in nested.pair_table(n).orderBy("pair_no").collect()] == [(1, 0), (1, 1)]


def test_null_and_empty_conversations(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None])], "row_id long, conversations array<struct<from:string,value:string>>")
    assert nested.nodes(nested.turns(df)).count() == 0


def test_a_table_for_every_path(spark):
    deep = {"segments": [{"a": 1, "tags": ["x", "y"], "frames": [{"objects": [{"id": "o1"}, {"id": "o2"}]}, {"objects": []}]}], "notes": [{"by": "me"}]}
    n = rows(spark, [json.dumps(deep), TEXT]).cache()
    got = {r.schema_path: (r.parent_path, r.records, r.nodes) for r in nested.paths(n).collect()}
    assert got["segments[].frames[].objects[]"] == ("segments[].frames[]", 1, 2) and got["notes[]"] == ("", 1, 1) and got["segments[]"] == ("", 2, 3)
    objects = nested.path_table(n, "segments[].frames[].objects[]", ["id"]).collect()
    frames = {tuple(r.dewey) for r in nested.path_table(n, "segments[].frames[]").collect()}
    assert sorted((r.id, r.place) for r in objects) == [("o1", 0), ("o2", 1)] and {tuple(r.parent_dewey) for r in objects} <= frames
    first = nested.path_table(n, "segments[]").filter("row_id = 0").first()
    assert json.loads(first.body) == {"a": 1, "tags": ["x", "y"]}
