"""Queries on small graphs: an order is a graph, its lines are the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.operators import graph as g
from segloom.operators.components import components
from segloom.session import table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


def graph_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Lines refer to the line of their supplier modulo eight: repeated and dangling ids, loops, references to later lines."""
    li = _lines(spark, folder)
    nodes = li.select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_shipdate").alias("start"))
    edges = li.select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").cast("long").alias("a"), (F.col("l_suppkey") % 8).alias("b"))
    return g.faults(nodes, edges)


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # an order's few lines
    return _lines(spark, folder).withColumn("k", F.row_number().over(w)).withColumn("id", F.col("l_orderkey") * 100 + F.col("k")).withColumn("q", F.lag("l_quantity").over(w))


def graph_identities(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring lines of like quantity are one identity; two of one supplier's last digit conflict."""
    rows = _numbered(spark, folder)
    links = rows.filter(F.abs(F.col("l_quantity") - F.col("q")) < 15).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    return g.identities(rows.select("id", (F.col("l_suppkey") % 10).alias("scope")), links)


def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    """Documents linked to the clips that they are about, and to other copies of their text: sizes of the components."""
    d, m = table(spark, folder, "documents"), table(spark, folder, "manifest")
    about = d.select("doc_id", "video_id").join(m.select("video_id", "row_id").distinct(), "video_id").select(F.col("doc_id").alias("a"), F.col("row_id").alias("b"))
    texts = d.filter("text is not null").select("doc_id", F.sha2("text", 256).alias("t"))
    copies = texts.join(texts.groupBy("t").agg(F.min("doc_id").alias("b")), "t").select(F.col("doc_id").alias("a"), "b")
    return components(about.unionByName(copies)).groupBy("component").agg(F.count("*").alias("n"))


def graph_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's lines kept by a verdict (odd numbers), edges between kept ones, and scoped ids."""
    by = _numbered(spark, folder).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("id")))).alias("items"))
    ids = F.transform("items", lambda x: x["id"])
    edges = F.when(F.size("items") > 1, F.transform(F.sequence(F.lit(1), F.size("items") - 1), lambda i: F.struct(i.alias("a"), F.least(i + 2, F.size("items")).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    rows = by.select("l_orderkey", "items", edges.alias("edges"), F.filter(ids, lambda x: x % 2 == 1).alias("names"))
    return rows.select(
        "l_orderkey", F.array_join(g.scoped(g.kept(F.col("items"), F.col("names")), F.col("l_orderkey")), ",").alias("nodes"), F.size(g.kept_edges(F.col("edges"), F.col("names"))).alias("edges")
    )


ORACLE = {
    "graph_faults": """with n as (select l_orderkey as graph, cast(l_linenumber as bigint) as id, count(*) as n, min(l_shipdate) as start from lineitem group by 1, 2), o as (select graph, count(*) filter (n > 1) as repeated_ids from n group by 1),
e as (select l_orderkey as graph, cast(l_linenumber as bigint) as a, l_suppkey % 8 as b from lineitem),
x as (select e.*, na.start as sa, nb.start as sb, na.id is null or nb.id is null as d from e left join n na on na.graph = e.graph and na.id = e.a left join n nb on nb.graph = e.graph and nb.id = e.b)
select graph, any_value(repeated_ids) as repeated_ids, count(*) filter (d) as dangling, count(*) filter (a = b) as loops, count(*) filter (sa > sb) as reversed_edges from x join o using (graph) group by 1""",
    "graph_identities": """with r as (select *, row_number() over w as k, lag(l_quantity) over w as q from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)),
i as (select l_orderkey * 100 + k as id, l_orderkey, l_suppkey % 10 as scope, sum(case when abs(l_quantity - q) < 15 then 0 else 1 end) over (partition by l_orderkey order by k rows unbounded preceding) as run from r),
f as (select *, min(id) over (partition by l_orderkey, run) as identity from i), c as (select identity, scope, count(*) as n from f group by 1, 2), m as (select identity, max(n) > 1 as conflict from c group by 1)
select id, identity, conflict from f join m using (identity)""",
    "graph_components": """with recursive e as (select distinct doc_id as a, row_id as b from documents join manifest using (video_id) union select doc_id, min(doc_id) over (partition by text) from documents where text is not null),
n as (select a as u, b as v from e where a <> b union select b, a from e where a <> b),
r as (select u as node, u as c from n union select n.v, r.c from r join n on n.u = r.node where r.c < n.v), m as (select node, min(c) as component from r group by 1)
select component, count(*) as n from m group by 1""",
    "graph_projection": """with r as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as k, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey, string_agg(l_orderkey || ':' || k, ',' order by k) filter (k % 2 = 1) as nodes, cast(count(*) filter (k < n and k % 2 = 1 and least(k + 2, n) % 2 = 1) as integer) as edges from r group by 1""",
}
QUERIES = {f.__name__: f for f in (graph_faults, graph_identities, graph_components, graph_projection)}
