"""Checks and identities of small graphs stored as rows: nodes ``graph, id`` and edges ``graph, a, b``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.operators.components import components


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, repeated_ids, dangling, loops, reversed_edges``: per graph how often each rule is broken.

    nodes: ``graph, id, start``; edges: ``graph, a, b``, of which a has to start no later than b.
    """
    ids = nodes.groupBy("graph", "id").agg(F.count("*").alias("n"), F.min("start").alias("start"))
    own = ids.groupBy("graph").agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    at = lambda end: ids.select("graph", F.col("id").alias(end), F.col("start").alias(f"start_{end}"))
    e = edges.join(at("a").withColumn("has_a", F.lit(True)), ["graph", "a"], "left").join(at("b").withColumn("has_b", F.lit(True)), ["graph", "b"], "left")
    by = e.groupBy("graph").agg(
        F.count_if(F.col("has_a").isNull() | F.col("has_b").isNull()).alias("dangling"),
        F.count_if(F.col("a") == F.col("b")).alias("loops"),
        F.count_if(F.col("start_a") > F.col("start_b")).alias("reversed_edges"),
    )
    return own.join(by, "graph", "full").fillna(0)


def identities(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, identity, conflict``: observations joined by links are one identity; it conflicts with two of one scope.

    nodes: ``id, scope``; links: ``a, b``. Which links are read first doesn't matter.
    """
    part = components(links)
    rows = nodes.join(part, "id", "left").withColumn("identity", F.coalesce("component", "id")).drop("component")
    by = rows.groupBy("identity", "scope").agg(F.count("*").alias("n")).groupBy("identity").agg((F.max("n") > 1).alias("conflict"))
    return rows.join(by, "identity").select("id", "identity", "conflict")


def refusing(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, identity, refused``: as ``identities``, but a link that would put two of one scope together is refused.

    links: ``a, b, rank``; they are taken by rank, a and b. ``refused`` counts the links of the node as ``a`` that were. Only
    links of one component can bear on each other, so each component is taken on its own.
    """
    part = components(links).withColumnRenamed("id", "a")
    scope = lambda c: nodes.select(F.col("id").alias(c), F.col("scope").cast("string").alias(f"scope_{c}"))
    rows = links.join(part, "a").join(scope("a"), "a").join(scope("b"), "b").select("component", "rank", "a", "b", "scope_a", "scope_b")
    # A task takes whole components one after the other: what bears on one another has to be taken in turn.
    found = rows.repartition("component").sortWithinPartitions("component", "rank", "a", "b").mapInArrow(_refuse, "id long, identity long, refused long")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("identity", "id").alias("identity"), F.coalesce("refused", F.lit(0)).alias("refused"))


class _Groups:
    """Observations joined as long as no two of one scope would meet."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.scopes: dict[int, set] = {}
        self.refused: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(self, a: int, b: int, scope_a, scope_b) -> None:
        for x, s in ((a, scope_a), (b, scope_b)):
            if x not in self.root:
                self.root[x], self.scopes[x] = x, {s}
        x, y = sorted((self.find(a), self.find(b)))
        if x == y:
            return
        if self.scopes[x] & self.scopes[y]:
            self.refused[a] = self.refused.get(a, 0) + 1
            return
        self.root[y] = x
        self.scopes[x] |= self.scopes.pop(y)

    def rows(self) -> list[tuple[int, int, int]]:
        return [(x, self.find(x), self.refused.get(x, 0)) for x in self.root]


def _refuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, groups, out = None, _Groups(), []
    pack = lambda rows: pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["id", "identity", "refused"])
    for batch in batches:
        for component, a, b, scope_a, scope_b in zip(*(batch.column(c).to_pylist() for c in ("component", "a", "b", "scope_a", "scope_b"))):
            if component != at:
                out += groups.rows()
                at, groups = component, _Groups()
            groups.link(a, b, scope_a, scope_b)
        if len(out) > 10_000:
            yield pack(out)
            out = []
    out += groups.rows()
    if out:
        yield pack(out)


def kept(items: Column, names: Column) -> Column:
    """The items whose ``id`` is listed."""
    return F.filter(items, lambda x: F.array_contains(names, x["id"]))


def kept_edges(edges: Column, names: Column) -> Column:
    """The edges both of whose ends are listed."""
    return F.filter(edges, lambda e: F.array_contains(names, e["a"]) & F.array_contains(names, e["b"]))


def scoped(items: Column, prefix: Column) -> Column:
    return F.transform(items, lambda x: F.concat_ws(":", prefix.cast("string"), x["id"].cast("string")))
