"""Deeply nested records as related flat tables, by Dewey labels.

Every node of a record gets the path of ordinals that leads to it: the turn's place, then for each step the place of the
member or element. A parent's label is a prefix of its children's, so parent links are had by truncation and need no
join. Nodes are grouped by their schema path (member names, with ``[]`` for an element); each schema path of objects is
a table of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions.embedded_json import find_value

NODES = "row_id long, turn_no long, dewey array<int>, schema_path string, steps array<int>, body string"
#: Members that hold another list under each element; the first list met is the list of the record itself.
PAIR_MEMBERS = ("candidate_pairs", "pairs")


def label(value, dewey=(), path="", steps=()) -> Iterator[tuple[tuple, str, tuple, object]]:
    """``(dewey, schema path, depth of every enclosing list, element)`` of all list elements, in document order."""
    if isinstance(value, dict):
        for i, (name, child) in enumerate(value.items()):
            if isinstance(child, (dict, list)):
                yield from label(child, (*dewey, i), f"{path}.{name}" if path else name, steps)
    elif isinstance(value, list):
        inner = f"{path}[]"
        for i, child in enumerate(value):
            at = (*dewey, i)
            yield at, inner, (*steps, len(at)), child
            if isinstance(child, (dict, list)):
                yield from label(child, at, inner, (*steps, len(at)))


def _flat(value) -> str:
    """The members of an element that aren't tables themselves, as JSON text; lists of plain values stay."""
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if not (isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v))}
    return json.dumps(value, ensure_ascii=False)


def _nodes(bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row_id, turn_no, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                value = find_value(text)
                if value is None:
                    continue
                for dewey, path, steps, element in label(value):
                    for column, x in zip(out, (row_id, turn_no, dewey, path, steps, _flat(element) if bodies else None)):
                        column.append(x)
            yield pa.record_batch(
                [
                    pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.list_(pa.int32())),
                    pa.array(out[3], pa.string()),
                    pa.array(out[4], pa.list_(pa.int32())),
                    pa.array(out[5], pa.string()),
                ],
                ["row_id", "turn_no", "dewey", "schema_path", "steps", "body"],
            )

    return run


def turns(records: DataFrame, key: str = "row_id", conversations: str = "conversations") -> DataFrame:
    """``row_id, turn_no, role, value``, a row per turn; null and empty conversations have none."""
    return records.select(F.col(key).alias("row_id"), F.posexplode(conversations).alias("turn_no", "t")).select(
        "row_id", F.col("turn_no").cast("long").alias("turn_no"), F.col("t.from").alias("role"), F.col("t.value").alias("value")
    )


def nodes(turn_rows: DataFrame, bodies: bool = True) -> DataFrame:
    """Labelled list elements of the JSON held by the ``gpt`` turns; texts without whole JSON have none."""
    return (
        turn_rows.filter((F.col("role") == "gpt") & F.col("value").rlike(r"[\[{]"))
        .select("row_id", "turn_no", "value")
        .mapInArrow(_nodes(bodies), NODES)
    )


def place(depth: Column | int) -> Column:
    """The ordinal at a depth of the label (1-based)."""
    return F.element_at("dewey", depth if isinstance(depth, Column) else F.lit(depth)).cast("long")


def parent(dewey: str = "dewey", steps: str = "steps") -> Column:
    """The label of the enclosing list element, by truncation; empty for elements of the record's own list."""
    return F.slice(dewey, F.lit(1), F.when(F.size(steps) > 1, F.element_at(steps, -2)).otherwise(F.lit(0)))


def path_table(labelled: DataFrame, path: str, members: list[str] = []) -> DataFrame:  # noqa: B006
    """The table of one schema path: its keys (``row_id, turn_no, dewey``), the link to the parent, and members as text.

    Any list of objects at any depth has its table so; ``parent_dewey`` is the ``dewey`` of the row it belongs to in the
    table of the path without its last list, empty for lists of the record itself. A member that isn't there is null.
    """
    own = [F.get_json_object("body", f"$['{m}']").alias(m) for m in members]
    return labelled.filter(F.col("schema_path") == path).select("row_id", "turn_no", "dewey", parent().alias("parent_dewey"), place(F.element_at("steps", -1)).alias("place"), *own, "body")


def paths(labelled: DataFrame) -> DataFrame:
    """``schema_path, parent_path, records, nodes`` of every table that the records hold."""
    above = F.regexp_replace("schema_path", r"\.?[^\[\]]*\[\]$", "")
    rows = labelled.withColumn("parent_path", above).groupBy("schema_path", "parent_path")
    return rows.agg(F.countDistinct("row_id").alias("records"), F.countDistinct("row_id", "turn_no", "dewey").alias("nodes"))


def segment_table(labelled: DataFrame) -> DataFrame:
    """Elements of the record's own list: a schema path with one list, whatever objects it is wrapped in.

    Of several lists on that level (rare) those under ``segments`` count, else the bare list.
    """
    return labelled.filter(
        (F.size("steps") == 1) & (F.col("schema_path").rlike(r"(^|\.)segments\[\]$") | (F.col("schema_path") == "[]"))
    ).select("row_id", "turn_no", place(F.element_at("steps", -1)).alias("segment_no"), "dewey", "body")


def pair_table(labelled: DataFrame) -> DataFrame:
    """Elements of the candidate pairs of a segment, with the segment's place from the truncated label."""
    member = "|".join(PAIR_MEMBERS)
    return labelled.filter(
        (F.size("steps") == 2) & F.col("schema_path").rlike(rf"^(.*\.)?(segments)?\[\]\.({member})\[\]$")
    ).select(
        "row_id",
        "turn_no",
        F.element_at(parent(), -1).cast("long").alias("segment_no"),
        place(F.element_at("steps", -1)).alias("pair_no"),
        parent().alias("parent_dewey"),
        "dewey",
        "body",
    )
