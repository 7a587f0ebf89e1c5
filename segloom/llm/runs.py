"""Runs of identical or near-identical consecutive events, collapsed into one event each.

Adjacent agglomeration: the runs of an entity form a linked list; a priority queue holds the neighbouring runs that may
merge, most similar first; after each merge the similarity of the new run to its neighbours is computed anew, and merging
goes on until no neighbours meet the similarity and gap limits. Two runs are as similar as their least similar labels
(complete linkage), so which merge comes first matters: of ``a``, ``b``, ``c``, each near to the next, ``b`` joins the
nearer one, and the result may be too far from the other.

Neighbouring events that don't meet the limits never share a run, so the order is cut there into stretches; each task
goes through its range batch by batch and holds one stretch at a time, events of one label in it as one item. The first
and the last stretch of a task are open: they go on in its neighbours and are agglomerated with them in a last step. From
a similarity of ``VARIANT`` on, being alike is transitive, a stretch is a run, and an open one is a single row: two rows
a task. Below it an open stretch keeps an item for each change of label.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from segloom.functions.spelling import Vocabulary, edits, fold
from segloom.operators.ordered import in_order
from segloom.session import durable

RUNS = "entity string, first_id long, last_id long, events long, start_ms long, end_ms long, last_end_ms long, label string, labels array<string>, at int, place long, stretch long, open boolean"
_NAMES = [x.split()[0] for x in RUNS.split(", ")]
#: Of two events of one meaning: spelled alike, spelled differently; other labels are at most as alike as NEAR.
ALIKE, VARIANT, NEAR = 1.0, 0.9, 0.8


@dataclass(frozen=True)
class Limits:
    """Neighbours merge at this similarity or more, and if no more than this lies between them (None: any gap)."""

    similarity: float = VARIANT
    gap_ms: int | None = None

    def __post_init__(self):
        if not 0 < self.similarity <= ALIKE:
            raise ValueError("a similarity limit lies above 0 and not above 1")


def label_similarity(vocabulary: Vocabulary, a: str | None, b: str | None) -> float:
    """1 for the same spelling, 0.9 for two spellings of one canonical name; else 0.8 of the share of letters in common places
    (1 less edits by length); null is like nothing.
    """
    if a is None or b is None:
        return 0.0
    if a == b:
        return ALIKE
    name = vocabulary.canonical(a)
    if name is not None and name == vocabulary.canonical(b):
        return VARIANT
    x, y = fold(a), fold(b)
    longer = max(len(x), len(y))
    return NEAR * (1 - edits(x, y, longer) / longer) if longer else 0.0


class Likeness:
    """Remembers the similarity of labels; of two runs it is that of their least similar labels."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def of(self, a: str | None, b: str | None) -> float:
        if a == b and a is not None:
            return ALIKE
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[a, b] = self.known[b, a] = label_similarity(self.vocabulary, a, b)
        return got

    def runs(self, one: list, two: list) -> float:
        return min(self.of(a, b) for a in one for b in two)


def agglomerate(labels: list[list], likeness: Likeness, limit: float) -> list[int]:
    """The run number of each item of a stretch; ``labels`` holds those of each item.

    ``after`` and ``before`` are the linked list of runs by their first item; an entry of the queue is stale once either
    of its runs has changed. Ties go to the earlier place.
    """
    n = len(labels)
    held = [list(dict.fromkeys(x)) for x in labels]
    before, after = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    version, alive = [0] * n, [True] * n
    queue: list[tuple] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (like := likeness.runs(held[i], held[j])) >= limit:
            heapq.heappush(queue, (-like, i, j, version[i], version[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, j, v, w = heapq.heappop(queue)
        if not (alive[i] and alive[j] and version[i] == v and version[j] == w):
            continue
        held[i] += [x for x in held[j] if x not in held[i]]
        alive[j] = False
        version[i] += 1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return (np.cumsum(alive) - 1).tolist()


class _Item:
    """Consecutive events of one label (or of a run already made)."""

    __slots__ = ("end", "entity", "events", "first", "labels", "last", "last_end", "start")

    def __init__(self, entity, first, last, events, start, end, last_end, labels):
        self.entity, self.first, self.last, self.events = entity, first, last, events
        self.start, self.end, self.last_end, self.labels = start, end, last_end, labels

    def add(self, other: _Item) -> None:
        self.last, self.events, self.last_end = other.last, self.events + other.events, other.last_end
        self.end = max(self.end, other.end)
        self.labels = self.labels if other.labels == self.labels else list(dict.fromkeys(self.labels + other.labels))


class _Collapse:
    """Takes items in order and gives the runs of every stretch that has ended."""

    def __init__(self, vocabulary: Vocabulary, limits: Limits, edges: bool):
        self.likeness, self.limits, self.edges = Likeness(vocabulary), limits, edges
        self.vocabulary, self.whole = vocabulary, limits.similarity >= VARIANT
        self.stretch: list[_Item] = []
        self.first = True
        self.out: list[tuple] = []
        self.place = self.stretches = 0

    def follows(self, a: _Item, b: _Item) -> bool:
        near = self.limits.gap_ms is None or b.start - a.last_end <= self.limits.gap_ms
        return near and a.entity == b.entity and self.likeness.runs(a.labels, b.labels) >= self.limits.similarity

    def take(self, item: _Item) -> None:
        last = self.stretch[-1] if self.stretch else None
        if last is None or not self.follows(last, item):
            self.end(False)
            self.stretch = [item]
        elif self.whole or (last.labels == item.labels and len(item.labels) == 1):
            last.add(item)
        else:
            self.stretch.append(item)

    def end(self, final: bool) -> None:
        if not self.stretch:
            return
        held = self.edges and (self.first or final)
        items, self.stretch, self.first = self.stretch, [], False
        if not held and len(items) > 1:
            number = agglomerate([i.labels for i in items], self.likeness, self.limits.similarity)
            runs: list[_Item] = []
            for k, item in zip(number, items):
                if k < len(runs):
                    runs[k].add(item)
                else:
                    runs.append(item)
            items = runs
        for i in items:
            label = i.labels[0]
            name = None if label is None else self.vocabulary.canonical(label) or label
            self.out.append((i.entity, i.first, i.last, i.events, i.start, i.end, i.last_end, name, i.labels, self.place, self.stretches, held))
            self.place += 1
        self.stretches += 1


def _batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    c = list(zip(*rows))
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.string())]
    columns = [pa.array(x, k) for x, k in zip(c[:9], kinds)]
    return pa.record_batch([*columns, pa.array([part] * len(rows), pa.int32()), pa.array(c[9], pa.int64()), pa.array(c[10], pa.int64()), pa.array(c[11], pa.bool_())], _NAMES)


def _emitted(collapse: _Collapse, part: int, final: bool = False) -> Iterator[pa.RecordBatch]:
    if final:
        collapse.end(True)
    if len(collapse.out) > 10_000 or (final and collapse.out):
        yield _batch(collapse.out, part)
        collapse.out.clear()


def _heads(entity: pa.Array, label: pa.Array, start: np.ndarray, end: np.ndarray, gap: int | None) -> np.ndarray:
    """Rows of a batch at which the entity or the label changes or the gap is too long."""
    n = len(entity)
    same = np.zeros(n, bool)
    if n > 1:
        equal = lambda x: np.asarray(pc.fill_null(pc.equal(x.slice(1), x.slice(0, n - 1)), False))
        same[1:] = equal(entity) & equal(label)
        if gap is not None:
            same[1:] &= start[1:] - end[:-1] <= gap
    return np.flatnonzero(~same)


def _block(entries: dict[str, str], limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        collapse = _Collapse(Vocabulary(entries), limits, True)
        for batch in batches:
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            fresh = np.ones(len(ids), bool)  # an id that was delivered again is next to itself
            fresh[1:] = ids[1:] != ids[:-1]
            if len(ids):
                fresh[0], last = last is None or ids[0] != last, ids[-1]
            if not fresh.all():
                batch = pa.Table.from_batches([batch]).filter(pa.array(fresh)).combine_chunks()
                batch = batch.to_batches()[0] if batch.num_rows else None
            if batch is None or not batch.num_rows:
                continue
            entity, label = batch.column(0), batch.column(2)
            ids, start, end = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4))
            heads = _heads(entity, label, start, end, limits.gap_ms)
            tails = np.append(heads[1:], len(ids)) - 1
            top = np.maximum.reduceat(end, heads)
            columns = (entity.take(pa.array(heads)).to_pylist(), ids[heads].tolist(), ids[tails].tolist(), (tails - heads + 1).tolist(), start[heads].tolist(), top.tolist(), end[tails].tolist())
            for e, a, b, n, s, d, ld, name in zip(*columns, label.take(pa.array(heads)).to_pylist()):
                collapse.take(_Item(e, a, b, n, s, d, ld, [name]))
            yield from _emitted(collapse, part)
        yield from _emitted(collapse, part, True)

    return run


def _join_open(entries: dict[str, str], limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collapse, last = _Collapse(Vocabulary(entries), limits, False), (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                if r["at"] == last[0] and r["stretch"] != last[1]:
                    collapse.end(False)  # other stretches of the task lie between
                last = r["at"], r["stretch"]
                collapse.take(_Item(r["entity"], r["first_id"], r["last_id"], r["events"], r["start_ms"], r["end_ms"], r["last_end_ms"], r["labels"]))
            yield from _emitted(collapse, 0)
        yield from _emitted(collapse, 0, True)

    return run


def collapse_runs(events: DataFrame, entries: dict[str, str], limits: Limits = Limits()) -> DataFrame:
    """A row per run: ``entity, first_id, last_id, events, start_ms, end_ms, label`` (its duration is end less start).

    events: ``entity, id, label, start_ms, end_ms``; ordered by start and id within an entity. An id counts once. A null
    label is a run of its own, rows without entity belong to none and are left out, an empty table gives no runs.
    """
    rows = events.filter("entity is not null").select("entity", "id", "label", "start_ms", "end_ms")
    runs = durable(in_order(rows, "entity", "start_ms", "id").mapInArrow(_block(entries, limits), RUNS))
    edges = runs.filter("open").repartition(1).sortWithinPartitions("at", "place")  # two rows a task
    keep = ["entity", "first_id", "last_id", "events", "start_ms", "end_ms", "label"]
    return runs.filter("not open").select(keep).unionByName(edges.mapInArrow(_join_open(entries, limits), RUNS).select(keep))
