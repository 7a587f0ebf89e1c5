import json

import pytest

from segloom.sources import jsonl

SCHEMA = "id string, n int, segments array<int>"


def lines(tmp_path, name, rows):
    p = tmp_path / name
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(p)


def test_tolerant_and_strict(spark, tmp_path):
    p = lines(tmp_path, "a.jsonl", [{"id": "1", "n": 2}, "", "  ", "not json", "[1]", '{"id": "2"} trailing', '{"id": "3", "n": null}'])
    assert sorted((r.id, r.n) for r in jsonl.read_tolerant(spark, p, SCHEMA).collect()) == [("1", 2), ("3", None)]
    with pytest.raises(Exception):
        jsonl.read_strict(spark, p, SCHEMA).collect()


def test_whole_documents(spark, tmp_path):
    p = lines(tmp_path, "m.json", ['{"a": {"n": 1},', '"b": {"n": 2}}'])
    assert sorted((r.key, r.value.n) for r in jsonl.read_whole(spark, p, "struct<n:int>").collect()) == [("a", 1), ("b", 2)]
    assert [r.value for r in jsonl.read_list(spark, lines(tmp_path, "l.json", ['["x", "y"]'])).collect()] == ["x", "y"]
    with pytest.raises(Exception, match="not a list"):
        jsonl.read_list(spark, lines(tmp_path, "o.json", ["{}"])).collect()


def test_by_ending_and_tree(spark, tmp_path):
    (tmp_path / "t/x").mkdir(parents=True)
    (tmp_path / "t/x/one.json").write_text('{\n"id": "1"}')
    (tmp_path / "t/two.json").write_text('{"id": "2"}')
    (tmp_path / "t/no.txt").write_text("x")
    assert sorted(r.id for r in jsonl.read_tree(spark, str(tmp_path / "t"), SCHEMA).collect()) == ["1", "2"]
    assert jsonl.read_any(spark, str(tmp_path / "t/two.json")).first().id == "2"
    assert jsonl.read_any(spark, lines(tmp_path, "c.csv", ["id,n", "7,8"])).first().id == "7"
    r = jsonl.read_binary(spark, str(tmp_path / "t/no.txt")).first()
    assert (r.length, r.sha256[:6]) == (1, "2d7116")


def test_latest(spark, tmp_path):
    a = lines(tmp_path, "1.jsonl", [{"id": "x", "n": 1, "segments": [1]}, {"id": "y", "n": 1, "segments": [1]}])
    b = lines(tmp_path, "2.jsonl", [{"id": "x", "n": 2, "segments": []}, {"id": "y", "n": 2, "segments": [2]}, {"id": "y", "n": 3, "segments": [3]}])
    assert sorted((r.id, r.n) for r in jsonl.latest(spark, [a, b], SCHEMA, "id", "segments").collect()) == [("x", 1), ("y", 3)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a/b.jsonl", ("a/b.jsonl", (), None)), ("org/set:x/y#500", ("org/set", ("x", "y"), 500)), ("set#10", ("set", (), 10)), ("set:all", ("set", ("all",), None))],
)
def test_dataset_names(text, want):
    d = jsonl.DatasetName.parse(text)
    assert (d.path, d.subsets, d.count) == want


def test_dataset_name_refused():
    with pytest.raises(ValueError):
        jsonl.DatasetName.parse("")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "é"), ("b", None, "x")], "id string, n int, split string")
    out = str(tmp_path / "out.jsonl")
    jsonl.write_lines(df, out)
    with pytest.raises(Exception):
        jsonl.write_lines(df, out)
    jsonl.write_lines(df, out, "append")
    assert jsonl.read_strict(spark, out, "id string, n int").count() == 4
    jsonl.write_table(df, str(tmp_path / "t"), ["n", "absent"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).columns == ["n", "absent"]
    jsonl.write_splits(df, str(tmp_path / "s"))
    assert (tmp_path / "s/split=x").exists()
    jsonl.write_with_metrics(df, df.groupBy().count(), str(tmp_path / "m.jsonl"))
    assert (tmp_path / "m_metrics").exists()
