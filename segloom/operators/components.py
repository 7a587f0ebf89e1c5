"""Connected components of an undirected graph, as rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.operators.ordered import ranges
from segloom.session import durable, few


#: Edges that a task contracts at a time.
CHUNK = 500_000


def _stars(names: tuple[str, str], chunk: int | None, loops: bool):
    """Edges into stars: every node of a chunk (None: of all edges) with the least one that the chunk joins it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def out() -> pa.RecordBatch:
            rows = [(x, y) for x in root if (y := find(x)) != x or loops]
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), ()))], list(names))

        seen = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
                if x != y:
                    root[max(x, y)] = min(x, y)
            seen += batch.num_rows
            if chunk is not None and seen >= chunk:
                yield out()
                root.clear()
                seen = 0
        if root:
            yield out()

    return run


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``id, component`` (the least id of it) of all nodes with an edge. edges: ``a, b``, long; loops and repeats are allowed.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round hooks nodes to the least neighbour
    they know, so a path of n nodes takes about log n rounds; each round is two aggregations and is checkpointed. Before
    them each task turns chunks of neighbouring edges into stars, which leaves little to do where components lie together.
    As few edges as are sent to every task elsewhere are joined by one task instead.
    """
    pairs = durable(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    if few(pairs):
        return pairs.repartition(1).mapInArrow(_stars(("id", "component"), None, True), "id long, component long")
    near = pairs.repartitionByRange(ranges(pairs), "v", "u").sortWithinPartitions("v", "u")
    pairs = durable(near.select("u", "v").mapInArrow(_stars(("u", "v"), CHUNK, False), "u long, v long").distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(pairs)
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = durable(small.select("e.u", "e.v").filter("u <> v").distinct())
        after = mark(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
