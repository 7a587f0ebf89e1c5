"""Passes over a total order that no single task has to hold.

``in_order`` range-partitions rows by the whole ordering key, so a hot entity is spread over many tasks, and gives each
task its rows sorted. ``scan`` makes previous values and running sums on top of it: each task works on its range, and
what an entity brings over a task's edge (one row a task) is added afterwards. It stands in for a window whose partition
may hold any share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segloom.session import durable, partitions


#: Input bytes that a range is meant to hold.
RANGE_BYTES = 128 << 20


def ranges(df: DataFrame) -> int:
    """Ranges to cut ``df`` into: the session's shuffle partitions, and more where the files or checkpoints it reads call for it."""
    size = parts = 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.nodeName()
        if kind.startswith("LogicalRelation") or kind.startswith("Relation"):
            size += int(str(leaf.stats().sizeInBytes()))
        elif hasattr(leaf, "rdd") and "RDD" in kind:
            parts = max(parts, leaf.rdd().getNumPartitions())
    return max(partitions(df.sparkSession), parts, -(-size // RANGE_BYTES))


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(ranges(df), *keys).sortWithinPartitions(*keys)


def _shifted(column: pa.Array, before) -> pa.Array:
    head = pa.array([before], column.type)
    return pa.concat_arrays([head, column.slice(0, len(column) - 1)])


def _segmented_top(x: np.ndarray, goes_on: np.ndarray, held: float) -> np.ndarray:
    """The largest value so far of each entity; the first rows go on from ``held`` where they belong to its entity."""
    out = x.copy()
    cuts = [0, *np.flatnonzero(~goes_on).tolist(), len(x)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            out[a:b] = np.maximum.accumulate(x[a:b])
    lead = cuts[1] if len(cuts) > 2 else len(x)
    out[:lead] = np.maximum(out[:lead], held)
    return out


def _pass(entity: str, lags: list[str], sums: list[str], tops: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        row, first, last, held, totals, best = 0, None, None, [None] * len(lags), [0] * len(sums), [-np.inf] * len(tops)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            who = batch.column(entity)
            who = who.combine_chunks() if isinstance(who, pa.ChunkedArray) else who
            if row == 0:
                first = who[0].as_py()
            goes_on = np.array(pc.fill_null(pc.equal(who, _shifted(who, last)), False))
            if row == 0:
                goes_on[0] = False
            out = [batch.column(c) for c in names]
            for i, c in enumerate(lags):
                column = batch.column(c)
                shifted = _shifted(column, held[i])
                out.append(pc.if_else(pa.array(goes_on), shifted, pa.scalar(None, column.type)))
                held[i] = column[n - 1].as_py()
            for i, c in enumerate(sums):
                x = np.asarray(pc.fill_null(batch.column(c), 0)).astype(np.int64)
                total = np.cumsum(x)
                starts = np.flatnonzero(~goes_on)
                base = np.full(n, totals[i], np.int64)
                if len(starts):
                    offsets = np.concatenate(([0], total))[starts]
                    which = np.searchsorted(starts, np.arange(n), side="right") - 1
                    base = np.where(which >= 0, -offsets[np.maximum(which, 0)], totals[i])
                runs = total + base
                totals[i] = int(runs[-1])
                out.append(pa.array(runs))
            for i, c in enumerate(tops):
                x = np.asarray(pc.fill_null(pc.cast(batch.column(c), pa.float64()), -np.inf))
                largest = _segmented_top(x, goes_on, best[i])
                best[i] = float(largest[-1])
                out.append(pa.array(largest, mask=np.isneginf(largest)))
            lead = pc.fill_null(pc.equal(who, pa.scalar(first, who.type)), False)
            out += [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), lead]
            last, row = who[n - 1].as_py(), row + n
            yield pa.record_batch(out, [*names, *(f"prev_{c}" for c in lags), *(f"run_{c}" for c in sums), *(f"top_{c}" for c in tops), "_part", "_row", "_lead"])

    return run


def scan(df: DataFrame, entity: str, keys: list[str], lags: list[str] = [], sums: list[str] = [], tops: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with ``prev_<c>`` of the entity's row before (null for its first), ``run_<c>``, the sum, and ``top_<c>``, the
    largest value, up to the row.

    Rows are ordered by ``keys`` within the entity; keys that tie leave the order among them open. Rows without entity
    are left out; a null adds nothing to a sum and is no largest value. Sums are of whole numbers, largest values doubles.
    """
    names = df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    prev = [T.StructField(f"prev_{c}", kinds[c]) for c in lags]
    runs = [T.StructField(f"run_{c}", T.LongType()) for c in sums]
    runs += [T.StructField(f"top_{c}", T.DoubleType()) for c in tops]
    marks = [T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_lead", T.BooleanType())]
    rows = durable(
        in_order(df.filter(F.col(entity).isNotNull()), entity, *keys).mapInArrow(
            _pass(entity, lags, sums, tops, names), T.StructType([*df.schema.fields, *prev, *runs, *marks])
        )
    )
    # One row a task: what stands at its edges.
    edges = (
        rows.groupBy("_part")
        .agg(
            F.min_by(entity, "_row").alias("first"),
            F.max_by(F.struct(F.col(entity).alias("entity"), *lags, *(f"run_{c}" for c in sums), *(f"top_{c}" for c in tops)), "_row").alias("last"),
            F.bool_and("_lead").alias("single"),
        )
        .collect()
    )
    carried, held = [], None
    for e in sorted(edges, key=lambda e: e["_part"]):
        same = held is not None and held[0] == e["first"]
        if same:
            carried.append((e["_part"], *held[1], *held[2], *held[3]))
        ends, peaks = [e["last"][f"run_{c}"] for c in sums], [e["last"][f"top_{c}"] for c in tops]
        if same and e["single"]:
            ends = [a + b for a, b in zip(ends, held[2])]
            peaks = [max((x for x in p if x is not None), default=None) for p in zip(peaks, held[3])]
        held = (e["last"]["entity"], [e["last"][c] for c in lags], ends, peaks)
    schema = T.StructType(
        [T.StructField("_part", T.IntegerType()), *(T.StructField(f"_p_{c}", kinds[c]) for c in lags), *(T.StructField(f"_s_{c}", T.LongType()) for c in sums), *(T.StructField(f"_t_{c}", T.DoubleType()) for c in tops)]
    )
    extra = F.broadcast(df.sparkSession.createDataFrame(carried, schema))
    at_edge = F.col("_lead") & (F.col("_row") == 0)
    return rows.join(extra, "_part", "left").select(
        *names,
        *(F.when(at_edge, F.col(f"_p_{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in lags),
        *((F.col(f"run_{c}") + F.when(F.col("_lead"), F.coalesce(f"_s_{c}", F.lit(0))).otherwise(0)).alias(f"run_{c}") for c in sums),
        *(F.greatest(f"top_{c}", F.when(F.col("_lead"), F.col(f"_t_{c}"))).alias(f"top_{c}") for c in tops),
    )


def _decay(entity: str, value: str, weight: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = last = None
        y, rank, row = 0.0, 0, 0
        for batch in batches:
            who, values = batch.column(entity).to_pylist(), batch.column(value).to_pylist()
            first = who[0] if row == 0 and who else first
            ys, ranks = [], []
            for e, v in zip(who, values):
                y, rank = (y, rank) if row + len(ys) and e == last else (0.0, 0)
                last = e
                if v is not None:
                    y, rank = weight * y + (1 - weight) * v, rank + 1
                ys.append(y)
                ranks.append(rank)
            n = len(ys)
            lead = [e == first for e in who]
            yield pa.record_batch(
                [*(batch.column(c) for c in names), pa.array(ys, pa.float64()), pa.array(ranks, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(lead, pa.bool_())],
                [*names, "_y", "_n", "_part", "_row", "_lead"],
            )
            row += n

    return run


def smoothed(df: DataFrame, entity: str, keys: list[str], value: str, weight: float) -> DataFrame:
    """``df`` with ``smooth``: the entity's values up to the row, each ``weight`` times the next one's share, scaled to the sum 1.

    A task smooths its range; what the task before it hands on is one row, and fades by the weight for every value. A null
    value repeats what was before it; before any value ``smooth`` is null. Rows without entity are left out.
    """
    names = df.columns
    fields = [*df.schema.fields, T.StructField("_y", T.DoubleType()), T.StructField("_n", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_lead", T.BooleanType())]
    rows = durable(in_order(df.filter(F.col(entity).isNotNull()), entity, *keys).mapInArrow(_decay(entity, value, weight, names), T.StructType(fields)))
    edges = rows.groupBy("_part").agg(F.min_by(entity, "_row").alias("first"), F.max_by(F.struct(F.col(entity).alias("e"), "_y", "_n"), "_row").alias("last"), F.bool_and("_lead").alias("single")).collect()
    carried, held = [], None
    for e in sorted(edges, key=lambda e: e["_part"]):
        y, n = e["last"]["_y"], e["last"]["_n"]
        if held is not None and held[0] == e["first"]:
            carried.append((e["_part"], held[1], held[2]))
            if e["single"]:
                y, n = y + weight**n * held[1], n + held[2]
        held = (e["last"]["e"], y, n)
    extra = F.broadcast(df.sparkSession.createDataFrame(carried, "_part int, _cy double, _cn long"))
    joined = rows.join(extra, "_part", "left")
    lead = F.col("_lead") & F.col("_cy").isNotNull()
    y = F.col("_y") + F.when(lead, F.pow(F.lit(weight), F.col("_n")) * F.col("_cy")).otherwise(0.0)
    n = F.col("_n") + F.when(lead, F.col("_cn")).otherwise(0)
    return joined.select(*names, F.when(n > 0, y / (1 - F.pow(F.lit(weight), n))).alias("smooth"))
