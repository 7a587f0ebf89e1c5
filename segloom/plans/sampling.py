"""Queries of samples, splits, shards, packing lengths and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.operators import sampling as sm
from segloom.session import table

SEED = 41


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")


def smp_count(spark: SparkSession, folder: str) -> DataFrame:
    """More rows than there are: every document, and some once more."""
    return sm.sample_count(_docs(spark, folder), "doc_id", 1_234_567, SEED).select("doc_id", "copies")


def smp_percent(spark: SparkSession, folder: str) -> DataFrame:
    return sm.sample_share(_docs(spark, folder), "doc_id", 12.5, SEED).select("doc_id")


def smp_stratified(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen customers of each segment with a positive balance, by hash order."""
    w = Window.partitionBy("c_mktsegment").orderBy("h")  # a top 16 is kept of each segment, task by task
    rows = _customers(spark, folder).filter("c_acctbal > 0").withColumn("h", sm.hashed("c_custkey", SEED))
    return rows.withColumn("k", F.row_number().over(w)).filter("k <= 16").select("c_mktsegment", "k", "c_custkey")


def smp_excluding(spark: SparkSession, folder: str) -> DataFrame:
    """Sixty-four customers without an urgent order, by hash order."""
    o = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    rows = _customers(spark, folder).join(o, "c_custkey", "left_anti").withColumn("h", sm.hashed("c_custkey", SEED))
    return rows.orderBy("h").limit(64).select("c_custkey")


def smp_hash_split(spark: SparkSession, folder: str) -> DataFrame:
    """By hash order: the first 100 customers are dev, the next 500 train, the rest is left."""
    rows = sm.placed(_customers(spark, folder).select("c_custkey").withColumn("h", sm.hashed("c_custkey", SEED)), ["h"])
    return rows.select("c_custkey", F.when(F.col("rn") < 100, "dev").when(F.col("rn") < 600, "train").otherwise("left").alias("split"))


def smp_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the customers by hash for validation, per segment."""
    bucket = F.conv(F.substring(sm.hashed("c_custkey", SEED), 1, 8), 16, 10).cast("long") % 10_000
    rows = _customers(spark, folder).withColumn("split", F.when(bucket < 1000, "val").otherwise("train"))
    return rows.groupBy("c_mktsegment", "split").agg(F.count("*").alias("n"))


def smp_interleave(spark: SparkSession, folder: str) -> DataFrame:
    """Two streams at three to one until the first is used up, each in hash order."""
    a = sm.placed(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id")).withColumn("h", sm.hashed("id", SEED)), ["h"])
    b = sm.placed(_customers(spark, folder).select(F.col("c_custkey").alias("id")).withColumn("h", sm.hashed("id", SEED)), ["h"])
    at = lambda df, share, name: df.select(F.lit(name).alias("stream"), "id", F.round((F.col("rn") + 0.5) / share, 6).alias("due"), F.round(F.col("total") / share, 6).alias("ends"))
    both = at(a, 0.25, "supplier").unionByName(at(b, 0.75, "customer"))
    end = both.agg(F.min("ends").alias("stop"))
    return both.join(F.broadcast(end)).filter("due <= stop").select("stream", "id", "due")


def smp_interleave_all(spark: SparkSession, folder: str) -> DataFrame:
    """The same two streams until both are used up: the one that ends first is gone through again, in the same order."""
    a = sm.placed(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id")).withColumn("h", sm.hashed("id", SEED)), ["h"])
    b = sm.placed(_customers(spark, folder).select(F.col("c_custkey").alias("id")).withColumn("h", sm.hashed("id", SEED)), ["h"])
    at = lambda df, share, name: df.select(F.lit(name).alias("stream"), F.lit(share).alias("share"), "id", "rn", "total", F.round(F.col("total") / share, 6).alias("ends"))
    both = at(a, 0.25, "supplier").unionByName(at(b, 0.75, "customer"))
    both = both.join(F.broadcast(both.agg(F.max("ends").alias("stop"))))  # one row
    turns = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("stop") * F.col("share") / F.col("total")).cast("long"))
    rows = both.withColumn("turn", F.explode(turns)).withColumn("due", F.round((F.col("rn") + F.col("turn") * F.col("total") + 0.5) / F.col("share"), 6))
    return rows.filter("due <= stop").select("stream", "id", "turn", "due")


def smp_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """A shuffle within blocks of a thousand orders."""
    rows = table(spark, folder, "orders").select("o_orderkey").withColumn("block", F.floor(F.col("o_orderkey") / 1000)).withColumn("h", sm.hashed("o_orderkey", SEED))
    return rows.select("o_orderkey", "block", F.row_number().over(Window.partitionBy("block").orderBy("h")).alias("k"))  # a thousand keys a block


def smp_blind(spark: SparkSession, folder: str) -> DataFrame:
    """Blind codes in hash order, alternating between two coders."""
    rows = sm.placed(table(spark, folder, "supplier").select("s_suppkey").withColumn("h", sm.hashed("s_suppkey", SEED)), ["h"])
    return rows.select("s_suppkey", F.format_string("B%03d", F.col("rn") + 1).alias("code"), (F.col("rn") % 2).alias("coder"))


def smp_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Four negatives an order out of its parts: cut, or repeated from the front."""
    by = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))  # seven lines an order
    at = lambda i: F.element_at("p", (i % F.size("p") + 1).cast("int"))
    return by.select("l_orderkey", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), at).cast("array<string>"), ",").alias("negatives"))


def smp_first_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The first fifty valid parts in order of key."""
    rows = table(spark, folder, "part").filter("p_size between 10 and 40 and p_retailprice > 950")
    return rows.orderBy("p_partkey").limit(50).select("p_partkey")


def prt_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by id in seven shards: by even bounds, the first ones longer, round robin, equal pieces without the tail."""
    rows = sm.placed(_docs(spark, folder).select("doc_id"), ["doc_id"])
    size = F.floor(F.col("total") / 7)
    return rows.select(
        "doc_id", sm.linspace_shard(7).alias("linspace"), sm.even_shard(7).alias("even"), sm.round_robin(7).alias("robin"),
        F.when(F.col("rn") < size * 7, F.floor(F.col("rn") / size).cast("int")).alias("piece"),
    )


def prt_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of eight for four ranks, the incomplete rest dropped; micro-batches of two a rank."""
    rows = sm.placed(_docs(spark, folder).select("doc_id"), ["doc_id"])
    whole = F.floor(F.col("total") / 32) * 32
    return rows.filter(F.col("rn") < whole).select(
        "doc_id", (F.col("rn") % 4).cast("int").alias("rank"), F.floor(F.col("rn") / 32).cast("int").alias("batch"), F.floor(F.col("rn") % 32 / 8).cast("int").alias("micro")
    )


def top_emotions(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent labels of a clip, the smaller label first on a tie."""
    by = table(spark, folder, "segments").dropDuplicates(["segment_id"]).filter("emotion is not null").groupBy("video_id", "emotion").agg(F.count("*").alias("n"))
    w = Window.partitionBy("video_id").orderBy(F.desc("n"), "emotion")
    return by.withColumn("k", F.row_number().over(w)).filter("k <= 3").groupBy("video_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "emotion"))), lambda x: x["emotion"]), ",").alias("top")
    )


def top_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve most frequent pairs of source and language."""
    by = _docs(spark, folder).groupBy(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "source", "lang").limit(12)


def srt_natural(spark: SparkSession, folder: str) -> DataFrame:
    """Clip ids in natural order, numbers first by value: the place of each."""
    ids = table(spark, folder, "manifest").select("video_id").distinct()
    key = ids.withColumn("a", F.col("video_id").try_cast("long").isNull().cast("int")).withColumn("b", F.coalesce(F.col("video_id").try_cast("long"), F.lit(0)))
    return sm.placed(key, ["a", "b", "video_id"]).select("video_id", F.col("rn").alias("place"))


def pck_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each record in words, 21 more, and 576 a video mark."""
    turns = F.explode("conversations").alias("t")
    rows = table(spark, folder, "train").dropDuplicates(["row_id"]).select("row_id", turns).select("row_id", F.coalesce("t.value", F.lit("")).alias("v"))
    n = F.when(F.trim("v") == "", 0).otherwise(F.size(F.split(F.trim("v"), r"[ \n\t]+"))) + 576 * F.regexp_count("v", F.lit("<video>"))
    return rows.groupBy("row_id").agg((F.sum(n) + 21).alias("length"))


def pck_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose length is at most 200, and the number that is dropped, by source."""
    rows = pck_lengths(spark, folder).join(table(spark, folder, "train").select("row_id", F.coalesce("source", F.lit("none")).alias("source")).distinct(), "row_id")
    return rows.groupBy("source").agg(F.count_if(F.col("length") <= 200).alias("kept"), F.count_if(F.col("length") > 200).alias("dropped"))


def pck_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each text cut into chunks of a hundred words, and its first and last hundred."""
    w = F.split(F.trim("text"), r"[ \n\t]+")
    rows = table(spark, folder, "documents").select("doc_id", w.alias("w")).withColumn("n", F.size("w"))
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(100))).alias("at")
    return rows.select("doc_id", "n", "w", at).select(
        "doc_id", (F.col("at") / 100).cast("int").alias("chunk"), F.md5(F.array_join(F.slice("w", F.col("at") + 1, 100), " ")).alias("part"),
        F.md5(F.array_join(F.slice("w", 1, 100), " ")).alias("left"), F.md5(F.array_join(F.slice("w", F.greatest(F.col("n") - 99, F.lit(1)), 100), " ")).alias("right"),
    )


def pck_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as packed rows: positions restart for each line of (quantity mod 5) + 1 items."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity").cast("int") % 5 + 1).alias("n"))
    by = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "n"))).alias("x"))  # seven lines an order
    return by.select("l_orderkey", F.array_join(F.flatten(F.transform("x", lambda x: F.sequence(F.lit(0), x["n"] - 1))).cast("array<string>"), ",").alias("positions"))


_H = f"md5('{SEED}:' || {{}})"
_PLACED = "row_number() over (order by {}) - 1 as rn, count(*) over () as total"
ORACLE = {
    "smp_count": f"with p as (select doc_id, {_PLACED.format(_H.format('doc_id') + ', doc_id')} from documents), c as (select doc_id, cast(1234567 // total + case when rn < 1234567 % total then 1 else 0 end as bigint) as copies from p) select * from c where copies > 0",
    "smp_percent": f"select doc_id from documents where cast('0x' || substr({_H.format('doc_id')}, 1, 8) as bigint) % 10000 < 1250",
    "smp_stratified": f"with k as (select c_mktsegment, row_number() over (partition by c_mktsegment order by {_H.format('c_custkey')}) as k, c_custkey from customer where c_acctbal > 0) select * from k where k <= 16",
    "smp_excluding": f"select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderpriority = '1-URGENT') order by {_H.format('c_custkey')} limit 64",
    "smp_hash_split": f"with p as (select c_custkey, {_PLACED.format(_H.format('c_custkey'))} from customer) select c_custkey, case when rn < 100 then 'dev' when rn < 600 then 'train' else 'left' end as split from p",
    "smp_ratio": f"select c_mktsegment, case when cast('0x' || substr({_H.format('c_custkey')}, 1, 8) as bigint) % 10000 < 1000 then 'val' else 'train' end as split, count(*) as n from customer group by 1, 2",
    "smp_interleave": f"""with a as (select s_suppkey as id, {_PLACED.format(_H.format('s_suppkey'))} from supplier), b as (select c_custkey as id, {_PLACED.format(_H.format('c_custkey'))} from customer),
u as (select 'supplier' as stream, id, round((rn + 0.5::double) / 0.25::double, 6) as due, round(total / 0.25::double, 6) as ends from a
  union all select 'customer', id, round((rn + 0.5::double) / 0.75::double, 6), round(total / 0.75::double, 6) from b)
select stream, id, due from u where due <= (select min(ends) from u)""",
    "smp_interleave_all": f"""with a as (select s_suppkey as id, {_PLACED.format(_H.format('s_suppkey'))} from supplier), b as (select c_custkey as id, {_PLACED.format(_H.format('c_custkey'))} from customer),
u as (select 'supplier' as stream, 0.25::double as share, id, rn, total from a union all select 'customer', 0.75::double, id, rn, total from b),
s as (select *, max(round(total / share, 6)) over () as stop from u), t as (select *, unnest(range(0, cast(ceil(stop * share / total) as bigint) + 1)) as turn from s)
select stream, id, turn, round((rn + turn * total + 0.5::double) / share, 6) as due from t where round((rn + turn * total + 0.5::double) / share, 6) <= stop""",
    "smp_blocks": f"select o_orderkey, cast(o_orderkey // 1000 as bigint) as block, row_number() over (partition by o_orderkey // 1000 order by {_H.format('o_orderkey')}) as k from orders",
    "smp_blind": f"with p as (select s_suppkey, {_PLACED.format(_H.format('s_suppkey'))} from supplier) select s_suppkey, printf('B%03d', rn + 1) as code, rn % 2 as coder from p",
    "smp_negatives": """with d as (select distinct l_orderkey, l_partkey from lineitem), p as (select l_orderkey, list(l_partkey order by l_partkey) as p from d group by 1)
select l_orderkey, array_to_string(list_transform(range(0, 4), lambda i: p[i % len(p)::bigint + 1]), ',') as negatives from p""",
    "smp_first_valid": "select p_partkey from part where p_size between 10 and 40 and p_retailprice > 950 order by p_partkey limit 50",
    "prt_shards": f"""with p as (select doc_id, {_PLACED.format('doc_id')} from documents)
select doc_id, cast(((rn + 1) * 7 - 1) // total as integer) as linspace, cast(ntile(7) over (order by doc_id) - 1 as integer) as even, cast(rn % 7 as integer) as robin,
  case when rn < total // 7 * 7 then cast(rn // (total // 7) as integer) end as piece from p""",
    "prt_batches": f"""with p as (select doc_id, {_PLACED.format('doc_id')} from documents)
select doc_id, cast(rn % 4 as integer) as rank, cast(rn // 32 as integer) as batch, cast(rn % 32 // 8 as integer) as micro from p where rn < total // 32 * 32""",
    "top_emotions": """with c as (select video_id, emotion, count(*) as n from (select distinct segment_id, video_id, emotion from segments where emotion is not null) group by 1, 2),
k as (select *, row_number() over (partition by video_id order by n desc, emotion) as k from c) select video_id, string_agg(emotion, ',' order by k) as top from k where k <= 3 group by 1""",
    "top_sources": "select coalesce(source, 'none') as source, coalesce(lang, 'none') as lang, count(*) as n from documents group by 1, 2 order by n desc, source, lang limit 12",
    "srt_natural": """with d as (select distinct video_id from manifest where video_id is not null)
select video_id, row_number() over (order by case when try_cast(video_id as bigint) is null or not regexp_full_match(video_id, '\\s*[+-]?[0-9]+\\s*') then 1 else 0 end, coalesce(try_cast(case when regexp_full_match(video_id, '\\s*[+-]?[0-9]+\\s*') then video_id end as bigint), 0), video_id) - 1 as place from d""",
    "pck_lengths": """with t as (select row_id, unnest(conversations) as t from (select distinct row_id, conversations from train)), v as (select row_id, coalesce(t.value, '') as v from t)
select row_id, cast(sum(case when trim(v, ' ') = '' then 0 else len(regexp_split_to_array(trim(v, ' '), '[ \\n\\t]+')) end + 576 * len(regexp_extract_all(v, '<video>'))) + 21 as bigint) as length from v group by 1""",
    "pck_chunks": """with w as (select doc_id, regexp_split_to_array(trim(text, ' '), '[ \\n\\t]+') as w from documents where text is not null), c as (select doc_id, w, unnest(range(0, len(w)::bigint, 100)) as a from w)
select doc_id, cast(a // 100 as integer) as chunk, md5(array_to_string(w[a + 1 : a + 100], ' ')) as part, md5(array_to_string(w[1:100], ' ')) as "left", md5(array_to_string(w[greatest(len(w)::bigint - 99, 1) : len(w)::bigint], ' ')) as "right" from c""",
    "pck_positions": """with l as (select l_orderkey, l_linenumber, l_partkey, cast(floor(l_quantity) as integer) % 5 + 1 as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, cast(floor(l_quantity) as integer) % 5) as z from lineitem), x as (select *, unnest(range(0, n)) as i from l)
select l_orderkey, string_agg(cast(i as varchar), ',' order by z, i) as positions from x group by 1""",
}
ORACLE["pck_fit"] = f"with p as ({ORACLE['pck_lengths']}) select source, count(*) filter (length <= 200) as kept, count(*) filter (length > 200) as dropped from p join (select distinct row_id, coalesce(source, 'none') as source from train) using (row_id) group by 1"

QUERIES = {
    f.__name__: f
    for f in (
        smp_count, smp_percent, smp_stratified, smp_excluding, smp_hash_split, smp_ratio, smp_interleave, smp_interleave_all, smp_blocks, smp_blind, smp_negatives, smp_first_valid, prt_shards,
        prt_batches, top_emotions, top_sources, srt_natural, pck_lengths, pck_fit, pck_chunks, pck_positions,
    )
}
