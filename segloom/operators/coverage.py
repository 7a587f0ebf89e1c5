"""Continuous periods and gaps of the intervals of each entity.

Plan: every scan task folds its rows into partial interval lists (map-side combine); the partial lists are
range-partitioned by (entity, start), so an entity with a large share of all rows is spread over many tasks; each task
merges its lists by a linear pass. Only the first and the last entity of a task can go on in another one. Their
lists are joined through one summary row per task and entity (at most two rows a task), the root of the reduction tree:
what earlier tasks reach decides which intervals are swallowed, and which period the last one ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.operators.intervals import collapse
from segloom.operators.ordered import ranges
from segloom.session import durable

_PARTIAL = "entity string, start_ms long, end_ms long"
_LISTS = "part int, entity string, nth long, start_ms long, end_ms long, next_start long, last boolean"


def usable(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """``entity, start_ms, end_ms`` of the rows with an entity and two finite times of which the end is later.

    Times are seconds; they are rounded to whole milliseconds first, so an interval without a millisecond is unusable.
    """
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(9e14))  # noqa: E731  (NaN is above any number)
    return (
        df.filter(F.col(entity).isNotNull() & finite(start) & finite(end))
        .select(F.col(entity).cast("string").alias("entity"), ms(start).alias("start_ms"), ms(end).alias("end_ms"))
        .filter("end_ms > start_ms")
    )


#: Rows that a scan task folds at a time.
FOLDED = 1_000_000


def _columns(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    names = t.column("entity").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return names.dictionary, codes, t.column("start_ms").to_numpy(), t.column("end_ms").to_numpy()


def _partial_lists(slack: int):
    def fold(t: pa.Table) -> pa.RecordBatch:
        names, codes, starts, ends = _columns(t)
        order = np.lexsort((starts, codes))
        codes, starts, ends = collapse(codes[order], starts[order], ends[order], slack)
        return pa.record_batch([names.take(pa.array(codes)).cast(pa.string()), pa.array(starts), pa.array(ends)], ["entity", "start_ms", "end_ms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                rows += batch.num_rows
            if rows >= FOLDED:
                yield fold(pa.Table.from_batches(kept))
                kept, rows = [], 0
        if kept:
            yield fold(pa.Table.from_batches(kept))

    return run


def _merged_lists(slack: int):
    """Linear merge of a range in order, a batch at a time; the last period met is held until what follows it is known."""
    held_names = ["entity", "start_ms", "end_ms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, places = TaskContext.get().partitionId(), None, 0

        def out(names, codes, starts, ends, after, nth, last) -> pa.RecordBatch:
            n = len(codes)
            return pa.record_batch(
                [
                    pa.array(np.full(n, part, np.int32)), names.take(pa.array(codes)).cast(pa.string()), pa.array(nth), pa.array(starts), pa.array(ends),
                    pa.array(after, mask=last), pa.array(last),
                ],
                ["part", "entity", "nth", "start_ms", "end_ms", "next_start", "last"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch.select(held_names)])
            t = t if held is None else pa.concat_tables([held, t])
            names, codes, starts, ends = _columns(t)  # the rows come in order, so codes rise
            codes, starts, ends = collapse(codes, starts, ends, slack)
            n = len(codes)
            first = np.concatenate(([True], codes[1:] != codes[:-1]))
            at = np.arange(n)
            nth = at - np.maximum.accumulate(np.where(first, at, 0)) + np.where(codes == codes[0], places, 0)
            if n > 1:
                last = codes[1:] != codes[:-1]
                yield out(names, codes[:-1], starts[:-1], ends[:-1], starts[1:], nth[:-1], last)
            places = int(nth[-1])
            held = pa.table([names.take(pa.array(codes[-1:])).cast(t.schema.field("entity").type), pa.array(starts[-1:]), pa.array(ends[-1:])], held_names)
        if held is not None:
            names, codes, starts, ends = _columns(held)
            yield out(names, codes, starts, ends, np.zeros(1, np.int64), np.array([places]), np.array([True]))

    return run


def _join_edges(rows):
    """Of one entity, a row per task in order: where the task's last period ends, and what follows it."""
    import pandas as pd

    rows = rows.sort_values("part")
    out, open_at = [], None
    for r in rows.itertuples(index=False):
        if open_at is not None and not pd.isna(r.extension):
            out[open_at][2] = max(out[open_at][2], int(r.extension))
        if not pd.isna(r.last_end):
            if open_at is not None:
                out[open_at][3] = int(r.first_start)
            out.append([r.entity, r.part, int(r.last_end), None])
            open_at = len(out) - 1
    frame = pd.DataFrame(out, columns=["entity", "part", "closed_end", "following"])
    return frame.astype({"closed_end": "Int64", "following": "Int64"})


def periods(intervals: DataFrame, slack_ms: int) -> DataFrame:
    """``entity, start_ms, end_ms, next_start, first`` of every continuous period.

    intervals: ``entity, start_ms, end_ms`` as ``usable`` gives them; holes of at most ``slack_ms`` are bridged. An
    empty table gives none; repeated rows change nothing; ``next_start`` is null for the last period of an entity.
    """
    lists = durable(
        intervals.mapInArrow(_partial_lists(slack_ms), _PARTIAL)
        .repartitionByRange(ranges(intervals), "entity", "start_ms")
        .sortWithinPartitions("entity", "start_ms")
        .mapInArrow(_merged_lists(slack_ms), _LISTS)
    )
    # The first and the last entity of each task, a row a task.
    outer = lists.groupBy("part").agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
    lists = lists.join(F.broadcast(outer), "part").withColumn("edge", (F.col("entity") == F.col("low")) | (F.col("entity") == F.col("high")))
    inner = lists.filter("not edge").select("entity", "start_ms", "end_ms", "next_start", (F.col("nth") == 0).alias("first"))
    edge = lists.filter("edge")
    # At most two rows a task, whatever the data: safe to broadcast.
    before = Window.partitionBy("entity").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reach = edge.groupBy("entity", "part").agg(F.max("end_ms").alias("top")).select(
        "entity", "part", F.max("top").over(before).alias("reach")
    )
    edge = edge.join(F.broadcast(reach), ["entity", "part"]).withColumn(
        "fresh", F.col("reach").isNull() | (F.col("start_ms") > F.col("reach") + slack_ms)
    )
    ends = edge.groupBy("entity", "part").agg(
        F.max(F.when(~F.col("fresh"), F.col("end_ms"))).alias("extension"),
        F.min(F.when(F.col("fresh"), F.col("start_ms"))).alias("first_start"),
        F.max(F.when(F.col("fresh"), F.col("end_ms"))).alias("last_end"),
    )
    closed = ends.groupBy("entity").applyInPandas(
        _join_edges, "entity string, part int, closed_end long, following long"
    )
    edge = (
        edge.filter("fresh")
        .join(F.broadcast(closed), ["entity", "part"])
        .select(
            "entity",
            "start_ms",
            F.when(F.col("last"), F.col("closed_end")).otherwise(F.col("end_ms")).alias("end_ms"),
            F.when(F.col("last"), F.col("following")).otherwise(F.col("next_start")).alias("next_start"),
            (F.col("reach").isNull() & (F.col("nth") == 0)).alias("first"),
        )
    )
    return inner.unionByName(edge)


def periods_and_gaps(periods_of: DataFrame, limits: DataFrame, slack_ms: int) -> DataFrame:
    """``entity, kind, start_ms, end_ms``: the periods, and the gaps from 0 to the limit of the entity.

    limits: ``entity, limit_ms``; a null or absent limit, or one not above 0, leaves the end open.
    """
    tail = (
        periods_of.filter("next_start is null")
        .join(limits.filter("entity is not null").groupBy("entity").agg(F.max("limit_ms").alias("limit_ms")), "entity")
        .filter(F.col("limit_ms") > 0)
        .select("entity", F.lit("gap").alias("kind"), F.col("end_ms").alias("start_ms"), F.col("limit_ms").alias("end_ms"))
    )
    spans = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.col("end_ms").alias("a"), F.col("next_start").alias("b")),
        F.struct(F.lit("gap").alias("kind"), F.when(F.col("first"), F.lit(0)).cast("long").alias("a"), F.col("start_ms").alias("b")),
    )
    rows = periods_of.select("entity", F.explode(spans).alias("x")).select(
        "entity", "x.kind", F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms")
    )
    return rows.unionByName(tail).filter((F.col("kind") == "period") | (F.col("end_ms") - F.col("start_ms") > slack_ms))
