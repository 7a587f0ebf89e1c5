"""Items packed into containers of fixed capacity, bounded-space and online.

Items are spread over the tasks by a hash of their id. A task takes them as they come and holds a fixed number of open
containers for each capacity; an item goes into the one it fills best, and when it fits none, the fullest is closed and a
new one opened. What is open when a task ends is left over: at most that number a task and capacity, however many items
there are. The leftovers, taken as items of their filled size, are packed in the same way once more, in as many tasks as
their number calls for, and so on up a tree until one task holds what is left.

Only an item larger than the capacity is split: into full containers and a rest, which is packed like an item.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.operators.ordered import ranges
from segloom.session import durable, few

#: Open containers a task and capacity, and leftovers a task of the tree takes.
OPEN, TAKEN = 64, 50_000
_PACKED = "kind string, container string, doc_id long, piece int, first_token long, tokens long"
_MERGED = "kind string, container string, merged string, tokens long"


class Windows:
    """The open containers of one capacity: ``place`` gives the container of an item and the one that it closed."""

    def __init__(self, capacity: int, most: int, name: str):
        self.capacity, self.most, self.name = capacity, most, name
        self.room: list[tuple[int, int]] = []  # (room, container), sorted
        self.used = 0

    def fresh(self) -> int:
        self.used += 1
        return self.used - 1

    def place(self, size: int) -> tuple[int, int | None]:
        closed = None
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, container = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                closed = self.room.pop(0)[1]
            room, container = self.capacity, self.fresh()
        if room > size:
            insort(self.room, (room - size, container))
        return container, closed

    def open(self) -> list[tuple[int, int]]:
        """``(container, tokens in it)`` of those that aren't closed or full."""
        return [(c, self.capacity - room) for room, c in self.room]


def split(size: int, capacity: int) -> list[tuple[int, int]]:
    """``(first token, tokens)`` of the pieces of an item; one piece unless it exceeds the capacity."""
    if size <= capacity:
        return [(0, size)]
    return [(a, min(capacity, size - a)) for a in range(0, size, capacity)]


def _pack(capacities: dict[str, int], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in _PACKED.split(", ")]
        windows = {k: Windows(c, most, k) for k, c in capacities.items()}
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for kind, w in windows.items():
                rows = []
                for doc, size in zip(ids, sizes):
                    for piece, (first, tokens) in enumerate(split(size, w.capacity)):
                        container = w.fresh() if tokens == w.capacity else w.place(tokens)[0]
                        rows.append((kind, f"{part}-{container}", doc, piece, first, tokens))
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        # The leftovers: rows without a document.
        rows = [(kind, f"{part}-{c}", None, None, None, tokens) for kind, w in windows.items() for c, tokens in w.open()]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _merge(capacities: dict[str, int], most: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        names = [x.split()[0] for x in _MERGED.split(", ")]
        windows = {k: Windows(c, most, k) for k, c in capacities.items()}
        for batch in batches:
            rows = []
            for kind, container, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.append((kind, container, f"m{level}-{part}-{windows[kind].place(tokens)[0]}", None))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        rows = [(kind, None, f"m{level}-{part}-{c}", tokens) for kind, w in windows.items() for c, tokens in w.open()]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def merged(left: DataFrame, capacities: dict[str, int], most: int = OPEN, taken: int = TAKEN) -> DataFrame:
    """``kind, container, merged``: where each leftover container ends up. left: ``kind, container, tokens``, durable.

    A level of the tree packs its leftovers, fullest first, in tasks of about ``taken``; those open after it go up.
    """
    found, level, taken = None, 0, max(taken, 4 * most * len(capacities))  # so every level is a quarter of the one below, or less
    while True:
        tasks = -(-left.count() // taken)
        spread = left.repartition(tasks, "container") if tasks > 1 else left.repartition(1)
        rows = durable(spread.sortWithinPartitions(F.desc("tokens"), "container").select("kind", "container", "tokens").mapInArrow(_merge(capacities, most, level), _MERGED))
        step = rows.filter("container is not null").select("kind", "container", "merged")
        if found is None:
            found = step
        else:
            up = step.select("kind", F.col("container").alias("merged"), F.col("merged").alias("next"))
            found = durable(found.join(up, ["kind", "merged"], "left").select("kind", "container", F.coalesce("next", "merged").alias("merged")))
        if tasks <= 1:
            return found
        left, level = rows.filter("container is null").select("kind", F.col("merged").alias("container"), "tokens"), level + 1


def pack(sizes: DataFrame, capacities: dict[str, int], most: int = OPEN, taken: int = TAKEN) -> DataFrame:
    """``container_kind, container_id, doc_id, piece, first_token, tokens``: each item once (or its pieces) per capacity.

    sizes: ``doc_id, tokens``. An item of 0 tokens has a place, too. Capacities have to be above 0.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity is below 1")
    items = sizes.filter("tokens is not null").select("doc_id", "tokens")
    packed = durable(items.repartition(ranges(items), "doc_id").mapInArrow(_pack(capacities, most), _PACKED))
    left = merged(packed.filter("doc_id is null").select("kind", "container", "tokens"), capacities, most, taken)
    left = durable(left)
    return packed.filter("doc_id is not null").join(F.broadcast(left) if few(left) else left, ["kind", "container"], "left").select(
        F.col("kind").alias("container_kind"),
        F.coalesce("merged", "container").alias("container_id"),
        "doc_id",
        "piece",
        "first_token",
        "tokens",
    )


def violations(packed: DataFrame, sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``rule, cases``: how often a packing breaks a rule (each has to be 0); no rows without items."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("room")) for k, c in capacities.items())))
    room = F.element_at(F.create_map(*(F.lit(x) for k, c in capacities.items() for x in (k, c))), F.col("container_kind"))
    over = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > room).alias("over capacity"))
    docs = packed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"), F.max(F.col("first_token") + F.col("tokens")).alias("upto"))
    every = sizes.filter("tokens is not null").select("doc_id", F.col("tokens").alias("size"), kinds.alias("k")).select("doc_id", "size", F.col("k.kind").alias("container_kind"), "k.room")
    lost = every.join(docs, ["container_kind", "doc_id"], "full").agg(
        F.count_if(F.col("t").isNull() | F.col("size").isNull() | (F.col("t") != F.col("size")) | (F.col("upto") != F.col("size"))).alias("not whole"),
        F.count_if(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("room")))).alias("split for nothing"),
        F.count("*").alias("all"),
    )
    row = over.crossJoin(lost).filter("all > 0")  # one row each
    names = ["over capacity", "not whole", "split for nothing"]
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("cases")) for n in names))).alias("x")).select("x.rule", "x.cases")


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``container_kind, containers, tokens, share_used``. capacities: ``container_kind, capacity_tokens``."""
    by = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"))
    by = by.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return by.join(capacities, "container_kind").select(
        "container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("share_used")
    )
