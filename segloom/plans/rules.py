"""Queries of rules on matches, evidence, identities and media numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions import media
from segloom.operators import graph as g
from segloom.plans.timeline import six
from segloom.session import table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")  # an order's few lines
    return table(spark, folder, "lineitem").withColumn("k", F.row_number().over(w)).withColumn("id", F.col("l_orderkey") * 100 + F.col("k"))


def graph_refused(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order linked to the next one in turn; a link is refused where it would join two of one supplier's last digit."""
    rows = _lines(spark, folder)
    links = rows.filter("k > 1").select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("k").alias("rank"))
    return g.refusing(rows.select("id", (F.col("l_suppkey") % 4).alias("scope")), links)


def flt_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as answers that match objects of two frames: the rules that each breaks, counted.

    A line matches an object on the left with one on the right; matches are one to one and of one kind; a motion (lines of
    status F) is of moving objects, six at most, and none crosses a cut (orders of status P).
    """
    li = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_partkey") % 9).alias("a"), (F.col("l_suppkey") % 9).alias("b"), (F.col("l_linestatus") == "F").alias("motion"))
    li = li.groupBy("l_orderkey", "a", "b").agg(F.bool_or("motion").alias("motion"))
    by = li.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"), F.bool_or(F.col("a") % 2 != F.col("b") % 2).alias("mixed"),
        F.count_if("motion").alias("motions"), F.bool_or(F.col("motion") & ((F.col("a") % 2 == 0) | (F.col("b") % 2 == 0))).alias("still"),
    )
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "P").alias("bridge"))
    fault = (
        F.when((F.col("na") < F.col("n")) | (F.col("nb") < F.col("n")), "not one to one").when(F.col("mixed"), "two kinds").when(F.col("motions") > 6, "too many motions")
        .when(F.col("bridge") & (F.col("motions") > 0), "motion across a cut").when(F.col("still"), "motion of a still object").otherwise("valid")
    )
    return by.join(o, "l_orderkey").groupBy(fault.alias("fault")).agg(F.count("*").alias("n"))


def flt_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Clips as evidence over the models as arms: accepted if every arm answered, each under the same conditions; else the first reason."""
    o = table(spark, folder, "outputs").filter("video_id is not null and model is not null").dropDuplicates(["output_id"])
    arms = o.agg(F.countDistinct("model").alias("arms"))
    by = o.groupBy("video_id", "model").agg(F.bool_or(F.col("raw_output").isNotNull()).alias("answered"), F.array_join(F.array_sort(F.collect_set("condition_name")), ",").alias("conditions"))
    clip = by.groupBy("video_id").agg(F.count("*").alias("n"), F.bool_and("answered").alias("all"), F.min("conditions").alias("low"), F.max("conditions").alias("high"))
    clip = clip.join(F.broadcast(arms))  # one row
    why = F.when(F.col("n") < F.col("arms"), "an arm is missing").when(~F.col("all"), "an arm didn't answer").when(F.col("low") != F.col("high"), "conditions differ").otherwise("accepted")
    m = table(spark, folder, "manifest").dropDuplicates(["row_id"]).select("row_id", "video_id", F.coalesce("split_name", F.lit("none")).alias("split"))
    return m.join(clip.select("video_id", why.alias("why")), "video_id", "left").groupBy("split", F.coalesce("why", F.lit("no evidence")).alias("status")).agg(F.count("*").alias("n"))


def agg_contradicted(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct clips by kind of claim (the kind of prompt), of all claims and of those judged contradicted (a stopped run)."""
    o = table(spark, folder, "outputs").filter("video_id is not null").dropDuplicates(["output_id"])
    bad = F.coalesce(F.col("finish_reason").isin("length", "abort"), F.lit(False))
    return o.groupBy(F.coalesce("prompt_kind", F.lit("none")).alias("claim")).agg(F.count("*").alias("claims"), F.countDistinct("video_id").alias("clips"), F.countDistinct(F.when(bad, F.col("video_id"))).alias("contradicted"))


def num_resize(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as frames: their sides fitted to a factor, under two bounds of pixels, and the frames taken of a clip."""
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_size") * 37 + F.col("p_partkey") % 11).cast("long").alias("h"), (F.floor("p_retailprice") + 1).cast("long").alias("w"))
    a, b = media.fitted(F.col("h"), F.col("w"), 28), media.fitted(F.col("h"), F.col("w"), 28, 100 * 784, 300 * 784)
    n = media.frame_count(F.col("w"), (F.col("h") % 60 + 1).cast("double"))
    return p.select("p_partkey", a["height"].alias("height"), a["width"].alias("width"), b["height"].alias("small_height"), b["width"].alias("small_width"), n.alias("frames"))


def num_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Training steps of each source's documents at a batch of 16 over two and a half epochs; places of its size among fixed bounds."""
    d = table(spark, folder, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))
    bounds = F.array(*(F.lit(x).cast("long") for x in (10, 50, 100, 100, 1000)))
    return d.select("source", "n", media.steps(F.col("n"), 16, 2.5).alias("steps"), media.lower_bound(bounds, F.col("n")).alias("lower"), media.upper_bound(bounds, F.col("n")).alias("upper"))


def num_average_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The 64 numbers of each embedding as 8 by 8 brightness values: their average hash, and the bits in which neighbours differ."""
    e = table(spark, folder, "embeddings").select("vec_id", media.average_bits(F.transform("embedding", lambda x: x.cast("double"))).alias("bits"))
    o = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("bits").alias("before"))
    return e.join(o, "vec_id").select("vec_id", "bits", media.differing(F.col("bits"), F.col("before")).alias("differing"))


def seg_histogram_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as histograms of the frames of a clip a label: cuts where the distance to the frame before is large."""
    w = Window.partitionBy("label").orderBy("vec_id")  # the few frames of a small table's label
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"))
    e = e.withColumn("frame", F.row_number().over(w) - 1).withColumn("before", F.lag("h").over(w)).filter("before is not null")
    d = e.withColumn("d", six(media.bhattacharyya(F.col("before"), F.col("h")) * 100))
    return d.filter("d >= 30").select("label", F.round(F.col("frame") / 30.0, 3).alias("cut"), "d")


def txt_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut at delimiters (line ends with a mark, or a colon): characters by delimiter, weighted by a table of weights."""
    pattern = r"\n- |\n\d+\. |: |\n"
    weights = spark.createDataFrame([("", 1.0), ("\n- ", 0.5), (": ", 2.0), ("\n", 1.0)], "key string, weight double")
    rows = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.explode(media.delimited(F.col("text"), pattern)).alias("p")).select("doc_id", "p.key", F.char_length("p.content").alias("n"))
    by = rows.join(F.broadcast(weights), "key", "left").groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n").alias("characters"), six(F.sum(F.col("n") * F.coalesce("weight", F.lit(0.25)))).alias("weighted"))
    return by


def num_arguments(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as calls: their arguments against those of the next order, a part of which may lack."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 3).cast("string").alias("c"))
    args = F.when(F.col("o_orderkey") % 5 == 0, F.create_map(F.lit("status"), F.col("o_orderstatus"))).otherwise(
        F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("group"), F.col("c"))
    )
    rows = o.select("o_orderkey", args.alias("args"))
    after = rows.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("args").alias("other"))
    return rows.join(after, "o_orderkey").select("o_orderkey", six(media.soft_f1(F.col("args"), F.col("other"))).alias("score"))


def txt_quoted(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a case: whether the words quoted from its first answer (characters 11 to 40) stand in each."""
    o = table(spark, folder, "outputs").filter("raw_output is not null and case_id is not null").dropDuplicates(["output_id"])
    first = o.groupBy("case_id").agg(F.min_by(F.substring("raw_output", 11, 30), "output_id").alias("quote"))
    return o.join(first, "case_id").filter("quote <> ''").groupBy("case_id").agg(F.count("*").alias("answers"), F.count_if(F.contains("raw_output", F.col("quote"))).alias("quoting"))


_O = "o as (select distinct output_id, model, case_id, video_id, condition_name, prompt_kind, raw_output, finish_reason from outputs)"
_FIT = lambda least, most: f"""case when greatest(h, w) / least(h, w) > 200 then null
  when greatest(28, round_even(h / 28, 0) * 28) * greatest(28, round_even(w / 28, 0) * 28) > {most} then floor({{x}} / sqrt(h::double * w / {most}) / 28) * 28
  when greatest(28, round_even(h / 28, 0) * 28) * greatest(28, round_even(w / 28, 0) * 28) < {least} then ceil({{x}} * sqrt({least}::double / (h::double * w)) / 28) * 28
  else greatest(28, round_even({{x}} / 28, 0) * 28) end"""  # noqa: E731
_side = lambda least, most, x, name: f"cast({_FIT(least, most).format(x=x)} as bigint) as {name}"
ORACLE = {
    "graph_refused": """with recursive r as (select l_orderkey as o, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as bigint) as k, l_suppkey % 4 as scope from lineitem),
w as (select o, k, [scope] as held, o * 100 + k as identity, false as cut from r where k = 1
  union all select r.o, r.k, case when list_contains(w.held, r.scope) then [r.scope] else list_append(w.held, r.scope) end, case when list_contains(w.held, r.scope) then r.o * 100 + r.k else w.identity end, list_contains(w.held, r.scope)
  from w join r on r.o = w.o and r.k = w.k + 1)
select w.o * 100 + w.k as id, w.identity, cast(coalesce(n.cut, false) as bigint) as refused from w left join w n on n.o = w.o and n.k = w.k + 1""",
    "flt_one_to_one": """with l as (select l_orderkey, l_partkey % 9 as a, l_suppkey % 9 as b, bool_or(l_linestatus = 'F') as motion from lineitem group by 1, 2, 3),
b as (select l_orderkey, count(*) as n, count(distinct a) as na, count(distinct b) as nb, bool_or(a % 2 <> b % 2) as mixed, count(*) filter (motion) as motions, bool_or(motion and (a % 2 = 0 or b % 2 = 0)) as still from l group by 1)
select case when na < n or nb < n then 'not one to one' when mixed then 'two kinds' when motions > 6 then 'too many motions' when o_orderstatus = 'P' and motions > 0 then 'motion across a cut'
  when still then 'motion of a still object' else 'valid' end as fault, count(*) as n from b join orders on o_orderkey = l_orderkey group by 1""",
    "flt_evidence": f"""with {_O}, a as (select video_id, model, bool_or(raw_output is not null) as answered, string_agg(distinct condition_name, ',' order by condition_name) as conditions from o where video_id is not null and model is not null group by 1, 2),
c as (select video_id, count(*) as n, bool_and(answered) as every, min(coalesce(conditions, '')) as low, max(coalesce(conditions, '')) as high from a group by 1),
w as (select video_id, case when n < (select count(distinct model) from a) then 'an arm is missing' when not every then 'an arm didn''t answer' when low <> high then 'conditions differ' else 'accepted' end as why from c),
m as (select distinct row_id, video_id, coalesce(split_name, 'none') as split from manifest)
select split, coalesce(why, 'no evidence') as status, count(*) as n from m left join w using (video_id) group by 1, 2""",
    "agg_contradicted": f"""with {_O} select coalesce(prompt_kind, 'none') as claim, count(*) as claims, count(distinct video_id) as clips,
  count(distinct video_id) filter (finish_reason in ('length', 'abort')) as contradicted from o where video_id is not null group by 1""",
    "num_resize": f"""with p as (select p_partkey, p_size * 37 + p_partkey % 11 as h, cast(floor(p_retailprice) + 1 as bigint) as w from part),
f as (select *, floor(least(768, w) / 2) * 2 as high from p), n as (select *, floor(least(greatest(w / (h % 60 + 1)::double * 2.0, 4.0), high, w) / 2) * 2 as n from f)
select p_partkey, {_side(4 * 784, 16384 * 784, "h", "height")}, {_side(4 * 784, 16384 * 784, "w", "width")}, {_side(100 * 784, 300 * 784, "h", "small_height")}, {_side(100 * 784, 300 * 784, "w", "small_width")},
  case when n >= 2 and n <= w then cast(n as bigint) end as frames from n""",
    "num_steps": """with d as (select coalesce(source, 'none') as source, count(*) as n from documents group by 1)
select source, n, cast(ceil(2.5 * greatest(1, n // 16)) as bigint) as steps, cast(len(list_filter([10, 50, 100, 100, 1000], lambda x: x < n)) as integer) as lower, cast(len(list_filter([10, 50, 100, 100, 1000], lambda x: x <= n)) as integer) as upper from d""",
    "num_average_hash": """with e as (select vec_id, embedding::double[] as v from embeddings), m as (select vec_id, v, list_sum(v) / len(v) as m from e),
b as (select vec_id, list_transform(v, lambda x: case when x > m then '1' else '0' end) as b from m)
select b.vec_id, array_to_string(b.b, '') as bits, cast(len(list_filter(list_zip(b.b, o.b), lambda z: z[1] <> z[2])) as integer) as differing from b join b o on o.vec_id = b.vec_id - 1""",
    "seg_histogram_cuts": """with e as (select vec_id, label, list_transform(embedding::double[], lambda x: abs(x)) as h from embeddings),
f as (select *, row_number() over w - 1 as frame, lag(h) over w as before from e window w as (partition by label order by vec_id)),
d as (select label, frame, round(sqrt(greatest(0.0, 1 - list_sum(list_transform(list_zip(before, h), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(before) * list_sum(h)))) * 100, 6) as d from f where before is not null)
select label, round(frame / 30.0, 3) as cut, d from d where d >= 30""",
    "txt_spans": """with s as (select doc_id, list_concat([''], regexp_extract_all(text, '(\\n- |\\n\\d+\\. |: |\\n)', 1)) as k, string_split_regex(text, '\\n- |\\n\\d+\\. |: |\\n') as c from documents where text is not null),
p as (select doc_id, unnest(k) as k, length(unnest(c)) as n from s)
select doc_id, count(*) as parts, cast(sum(n) as bigint) as characters, round(sum(n * case k when '' then 1.0 when chr(10) || '- ' then 0.5 when ': ' then 2.0 when chr(10) then 1.0 else 0.25 end), 6)::double as weighted from p group by 1""",
    "num_arguments": """with o as (select o_orderkey as k, o_orderstatus as s, o_orderpriority as p, o_custkey % 3 as c, o_orderkey % 5 = 0 as few from orders),
j as (select a.k, case when a.few then 1 else 3 end as r, case when b.few then 1 else 3 end as n, case when a.s = b.s then 1.0 else 0.5 end + case when a.few or b.few then 0.0 else case when a.p = b.p then 1.0 else 0.5 end + case when a.c = b.c then 1.0 else 0.5 end end as h
  from o a join o b on b.k = a.k + 1)
select k as o_orderkey, round(2 * h / (r + n), 6)::double as score from j""",
    "txt_quoted": f"""with {_O}, a as (select distinct output_id, case_id, raw_output from o where raw_output is not null and case_id is not null), f as (select case_id, min_by(substr(raw_output, 11, 30), output_id) as quote from a group by 1)
select case_id, count(*) as answers, count(*) filter (contains(raw_output, quote)) as quoting from a join f using (case_id) where quote <> '' group by 1""",
}
QUERIES = {
    f.__name__: f
    for f in (graph_refused, flt_one_to_one, flt_evidence, agg_contradicted, num_resize, num_steps, num_average_hash, seg_histogram_cuts, txt_spans, num_arguments, txt_quoted)
}
