"""Queries that write and read back, run streams over files, and run code of the user's own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions import scorers
from segloom.operators import extensions as ex
from segloom.operators import segments as sg
from segloom.operators.records import only_columns
from segloom.plans.base import GT, PRED, gt, pred
from segloom.sources import jsonl
from segloom.session import shared_folder, table
from segloom.streaming.resume import source, stage

BUCKET = 20_000


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def io_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    """Answers written as lines among blank, broken and foreign ones, read back tolerantly: answers and characters by model."""
    path = _scratch(spark)
    o = table(spark, folder, "outputs").dropDuplicates(["output_id"])
    junk = F.element_at(F.array(*map(F.lit, ("", "  ", "not JSON", "[1, 2]", '{"model": ', "null", "7"))), (F.col("output_id") % 7 + 1).cast("int"))
    line = F.to_json(F.struct("output_id", "model", "raw_output"))
    o.select(F.explode(F.array(line, junk)).alias("value")).write.text(path)
    rows = jsonl.read_tolerant(spark, path, "output_id long, model string, raw_output string")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.sum(F.char_length("raw_output")).alias("characters"))


def io_appended(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written exclusively, appended once more, read strictly; a second exclusive writing is refused."""
    path = _scratch(spark)
    c = table(spark, folder, "customer")
    jsonl.write_lines(c, path)
    jsonl.write_lines(c, path, "append")
    try:
        jsonl.write_lines(c, path)
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "PATH_ALREADY_EXISTS" in str(e)
    rows = jsonl.read_strict(spark, path, "c_custkey long, c_mktsegment string, c_acctbal double")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.lit(refused).alias("refused"))


def io_table(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as CSV of fixed fields, one of which is absent, read back by ending."""
    path = f"{_scratch(spark)}.csv"
    jsonl.write_table(table(spark, folder, "part"), path, ["p_partkey", "p_brand", "p_size", "absent"])
    return jsonl.read_any(spark, path).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("size"), F.count("absent").alias("absent"))


def io_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in a folder a status, read back."""
    path = _scratch(spark)
    jsonl.write_splits(table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split"), "o_totalprice"), path)
    return jsonl.read_any(spark, path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def io_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Details beside their metrics, both read back."""
    path = f"{_scratch(spark)}.jsonl"
    s = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    jsonl.write_with_metrics(s, s.agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("mean")), path, "overwrite")
    details = jsonl.read_strict(spark, path, "s_suppkey long, s_acctbal double").agg(F.count("*").alias("details"), F.round(F.max("s_acctbal"), 6).alias("most"))
    return jsonl.read_strict(spark, path.replace(".jsonl", "_metrics"), "n long, mean double").join(F.broadcast(details))  # one row each


def io_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The nations (a fixed small table) as one object of objects, and their names as one list, read back."""
    path = _scratch(spark)
    n = table(spark, folder, "nation")
    entry = F.struct("n_name", F.struct("n_nationkey", "n_regionkey"))
    n.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(f"{path}/object")
    n.agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("value")).coalesce(1).write.text(f"{path}/list")
    listed = jsonl.read_list(spark, f"{path}/list").select(F.col("value").alias("name"))
    rows = jsonl.read_whole(spark, f"{path}/object", "struct<n_nationkey:int,n_regionkey:int>").filter("key is not null")
    return rows.join(listed, rows["key"] == listed["name"]).select("name", "value.n_nationkey", "value.n_regionkey")


def io_tree(spark: SparkSession, folder: str) -> DataFrame:
    """A document a nation, in a folder a region, found below the top."""
    path = _scratch(spark)
    n = table(spark, folder, "nation")
    n.withColumn("r", F.col("n_regionkey")).withColumn("k", F.col("n_nationkey")).write.partitionBy("r", "k").json(path)
    rows = jsonl.read_tree(spark, path, "n_nationkey int, n_name string, n_regionkey int")
    return rows.select("n_nationkey", "n_name", F.regexp_extract("_path", r"/r=(\d+)/", 1).cast("int").alias("region"))


def io_dataset_name(spark: SparkSession, folder: str) -> DataFrame:
    """Orders named with subsets and a count: those of the subsets, the first of them in hash order."""
    name = jsonl.DatasetName.parse("orders:F/P#300")
    rows = table(spark, folder, name.path).filter(F.col("o_orderstatus").isin(*name.subsets))
    return rows.orderBy(F.md5(F.col("o_orderkey").cast("string"))).limit(name.count).select("o_orderkey", "o_orderstatus")


def io_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in two files: of each case the last one in the order of the files that isn't empty."""
    path = _scratch(spark)
    o = table(spark, folder, "outputs").dropDuplicates(["output_id"]).filter("case_id is not null and model is not null")
    by = o.groupBy("case_id", "model").agg(F.max("output_id").alias("id"), F.max(F.coalesce(F.char_length("raw_output"), F.lit(0))).alias("n"))
    rows = by.select(F.concat_ws("|", "case_id", "model").alias("key"), "id", F.when(F.col("id") % 3 > 0, F.array("n")).otherwise(F.array().cast("array<int>")).alias("filled"))
    jsonl.write_lines(rows, f"{path}/1")
    jsonl.write_lines(rows.withColumn("id", F.col("id") + 1_000_000).withColumn("filled", F.when(F.col("id") % 2 > 0, F.col("filled")).otherwise(F.array().cast("array<int>"))), f"{path}/2")
    return jsonl.latest(spark, [f"{path}/1", f"{path}/2"], "key string, id long, filled array<int>", "key", "filled").select("key", "id")


def io_stage(spark: SparkSession, folder: str) -> DataFrame:
    """A stage over half of the orders, run again after the rest has arrived: each order once, in two runs."""
    path = _scratch(spark)
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    for rest in (0, 1):
        o.filter(F.col("o_orderkey") % 2 == rest).withColumn("run", F.lit(rest)).write.mode("append").parquet(f"{path}/in")
        rows = source(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema)
        stage(rows, lambda df: df.withColumn("double", F.col("o_orderkey") * 2), f"{path}/out", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("o_orderstatus", "run").agg(F.count("*").alias("n"), F.sum("double").alias("double"))


def flt_only_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs of the manifest, which may hold the id and the path and nothing that tells the answer."""
    rows = only_columns(table(spark, folder, "manifest").select("video_id", "video_path"), {"video_id", "video_path"})
    try:
        only_columns(table(spark, folder, "manifest"), {"video_id", "video_path"})
        refused = False
    except ValueError:
        refused = True
    return rows.distinct().withColumn("others_refused", F.lit(refused))


def join_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping segments of the two segmentations of a clip: pairs and common milliseconds."""
    p = pred(spark, folder).select("entity", F.col("idx").alias("i"), "s", "e")
    g = gt(spark, folder).select("entity", F.col("idx").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = sg.overlapping(p, g, BUCKET)
    return met.groupBy("entity").agg(F.count("*").alias("pairs"), F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("common"))


def srt_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Segments numbered within their clip by start and id."""
    return gt(spark, folder).select("id", "entity", "idx")


@scorers.column_scorer("long answer")
def _long(text):
    return (F.char_length(text) > 500).cast("double")


@scorers.batch_scorer("words")
def _words(texts):
    return [None if t is None else len(t.split(" ")) for t in texts]


@scorers.async_scorer("characters")
async def _characters(text):
    return None if text is None else len(text)


def udf_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Answers scored by a column expression, by a function of a batch and by an asynchronous one a row."""
    rows = table(spark, folder, "outputs").dropDuplicates(["output_id"]).select("output_id", "raw_output")
    for name, column in (("long answer", "long"), ("words", "words"), ("characters", "characters")):
        rows = scorers.score(rows, name, ["raw_output"], column)
    return rows.drop("raw_output")


def udaf_mean(spark: SparkSession, folder: str) -> DataFrame:
    """A metric with a state over all lines."""
    rows = ex.evaluated(table(spark, folder, "lineitem"), lambda: ex.Mean("l_quantity"), ["l_quantity"])
    return rows.select("name", F.round("value", 6).alias("value"))


def udtf_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in pieces of up to 1,000 characters."""
    rows = table(spark, folder, "documents").filter("text <> ''").select("doc_id", "text")
    return ex.grown(rows, lambda r: ((r["doc_id"], k, len(r["text"][at : at + 1000])) for k, at in enumerate(range(0, len(r["text"]), 1000))), "doc_id long, k int, n int")


class _Heap:
    """A heap of counters from which each step takes some."""

    def reset(self, row):
        self.left = row["n"]
        return self.left

    def step(self, action):
        self.left -= action
        return self.left, float(action), self.left <= 0

    def close(self):
        self.left = None


def udtf_played(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers played in an environment: one counter more is taken each step, four steps at most."""
    rows = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") % 12).alias("n"))
    return ex.played(rows, "s_suppkey", _Heap, lambda seen, past: len(past) + 1, 4)


_O = "o as (select distinct output_id, model, case_id, raw_output from outputs)"
ORACLE = {
    "io_tolerant": f"with {_O} select model, count(*) as n, cast(sum(length(raw_output)) as bigint) as characters from o group by 1",
    "io_appended": "select c_mktsegment, 2 * count(*) as n, round(2 * sum(c_acctbal), 2) as balance, true as refused from customer group by 1",
    "io_table": "select p_brand, count(*) as n, cast(sum(p_size) as bigint) as size, cast(0 as bigint) as absent from part group by 1",
    "io_splits": "select o_orderstatus as split, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1",
    "io_metrics": "select count(*) as n, round(avg(s_acctbal), 6) as mean, count(*) as details, round(max(s_acctbal), 6) as most from supplier",
    "io_whole": "select n_name as name, n_nationkey, n_regionkey from nation",
    "io_tree": "select n_nationkey, n_name, n_regionkey as region from nation",
    "io_dataset_name": "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') order by md5(cast(o_orderkey as varchar)) limit 300",
    "io_latest": f"""with {_O}, b as (select case_id || '|' || model as key, max(output_id) as id from o where case_id is not null and model is not null group by case_id, model)
select key, case when (id + 1000000) % 2 > 0 then id + 1000000 else id end as id from b where id % 3 > 0""",
    "io_stage": "select o_orderstatus, cast(o_orderkey % 2 as integer) as run, count(*) as n, cast(sum(o_orderkey * 2) as bigint) as double from orders group by 1, 2",
    "flt_only_columns": "select distinct video_id, video_path, true as others_refused from manifest",
    "join_overlaps": f"""with {PRED} select p.entity, count(*) as pairs, cast(sum(least(p.e, g.e) - greatest(p.s, g.s)) as bigint) as common from pred p join gt g on p.entity = g.entity and p.s < g.e and g.s < p.e group by 1""",
    "srt_numbered": f"with {GT} select id, entity, idx from gt",
    "udf_scores": f"with {_O} select output_id, case when length(raw_output) > 500 then 1.0 when raw_output is not null then 0.0 end::double as long, len(string_split(raw_output, ' '))::double as words, length(raw_output)::double as characters from o",
    "udaf_mean": "select 'mean' as name, round(avg(l_quantity), 6)::double as value from lineitem union all select 'n', count(*)::double from lineitem",
    "udtf_pieces": """with d as (select doc_id, length(text) as n from documents where text <> ''), k as (select doc_id, n, unnest(range(0, (n - 1) // 1000 + 1)) as k from d)
select doc_id, cast(k as integer) as k, cast(least(1000, n - k * 1000) as integer) as n from k""",
    "udtf_played": """with s as (select s_suppkey, s_suppkey % 12 as n, unnest(range(0, 4)) as k from supplier), x as (select *, n - (k + 1) * (k + 2) // 2 as left_, n - k * (k + 1) // 2 as before from s)
select s_suppkey, cast(k as integer) as step, cast(k + 1 as varchar) as action, cast(left_ as varchar) as observation, (k + 1)::double as reward, left_ <= 0 as done from x where k = 0 or before > 0""",
}
QUERIES = {
    f.__name__: f
    for f in (
        io_tolerant, io_appended, io_table, io_splits, io_metrics, io_whole, io_tree, io_dataset_name, io_latest, io_stage, flt_only_columns, join_overlaps, srt_numbered, udf_scores, udaf_mean,
        udtf_pieces, udtf_played,
    )
}
