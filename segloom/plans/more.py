"""Further queries: loops with scorers, text overlap scores, masked accuracies, divergences, bins, frame graphs, row layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions import overlap_scores
from segloom.functions import statistics as st
from segloom.operators import refine
from segloom.operators import sampling as sm
from segloom.operators import segments as sg
from segloom.plans.timeline import _LISTS, _lists
from segloom.session import table


def six(x):
    return F.round(x, 6)


def ref_merge_rescored(spark: SparkSession, folder: str) -> DataFrame:
    """Answers merged in order; a joined text of more than 300 characters is relabelled ``Interest``, others ``Joy``."""
    label = lambda text: F.when(F.char_length(text) > 300, "Interest").otherwise("Joy")
    rows = _lists(spark, folder).select("row_id", "turn_no", F.posexplode(refine.merge_rescored(F.col("segments"), label)).alias("k", "x"))
    return rows.select("row_id", "turn_no", "k", F.col("x.start_time").alias("s"), F.col("x.end_time").alias("e"), F.col("x.emotion").alias("label"), F.char_length("x.reason").alias("n"))


def ref_until_complete(spark: SparkSession, folder: str) -> DataFrame:
    """Clips halved until they last at most 10 seconds, four rounds at most."""
    m = table(spark, folder, "manifest").filter("video_duration > 0").select("row_id", F.round(F.col("video_duration") * 1000).cast("long").alias("ms")).distinct()
    rows = refine.until_complete(m, lambda d: d.withColumn("ms", F.floor(F.col("ms") / 2)), F.col("ms") <= 10_000, 4)
    return rows.groupBy("rounds").agg(F.count("*").alias("n"), F.max("ms").alias("most"))


def sta_overlap_scores(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE and BLEU of the event against the reason of a segment."""
    s = table(spark, folder, "segments").filter("event is not null and reason is not null").select("segment_id", "event", "reason").dropDuplicates(["segment_id"])
    return overlap_scores.scored(s, "event", "reason").select("segment_id", "rouge_1", "rouge_2", "rouge_l", "bleu_4")


def sta_unigram_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE-1 in columns: common words of event and reason, counted as often as in both."""
    s = table(spark, folder, "segments").filter("event is not null and reason is not null").select("segment_id", "event", "reason").dropDuplicates(["segment_id"])
    words = lambda c: s.select("segment_id", F.explode(F.split(F.trim(c), r"\s+")).alias("w")).groupBy("segment_id", "w").agg(F.count("*").alias(f"n_{c}"))
    by = words("event").join(words("reason"), ["segment_id", "w"], "full").fillna(0).groupBy("segment_id").agg(
        F.sum(F.least("n_event", "n_reason")).alias("common"), F.sum("n_event").alias("a"), F.sum("n_reason").alias("b")
    )
    return by.select("segment_id", six(200 * F.col("common") / (F.col("a") + F.col("b"))).alias("rouge_1"))


def sta_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings in eight clusters (k-means, seeded): sizes, largest first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, folder, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=8, seed=7, maxIter=10).fit(e)
    return model.transform(e).groupBy("prediction").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prediction")


def sta_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Jensen-Shannon divergence of the softmax of neighbouring embeddings, weighted one to three."""
    e = table(spark, folder, "embeddings").select("vec_id", st.softmax(F.transform("embedding", lambda x: x.cast("double"))).alias("p"))
    rows = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")

    def term(a, b):
        m = 0.25 * a + 0.75 * b
        return 0.25 * a * F.ln(a / m) + 0.75 * b * F.ln(b / m)

    return rows.select("vec_id", six(F.aggregate(F.zip_with("p", "q", term), F.lit(0.0), lambda s, x: s + x)).alias("jsd"))


def agg_masked_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as tokens of an order: status predicts the next flag, every fourth line masked; accuracy by token and by sequence."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")  # an order's few lines
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("p"), F.lead("l_returnflag").over(w).alias("y"))
    rows = rows.filter("y is not null and l_linenumber % 4 <> 0").withColumn("hit", (F.col("p") == F.col("y")).cast("int"))
    by = rows.groupBy("l_orderkey").agg(F.sum("hit").alias("h"), F.count("*").alias("n"))
    return by.agg(six(F.sum("h") / F.sum("n")).alias("token"), six(F.avg((F.col("h") == F.col("n")).cast("double"))).alias("sequence"))


def _ffd(capacity: int):
    def run(frame):
        import pandas as pd

        room: list[int] = []
        out = []
        for r in frame.sort_values(["length", "row_id"], ascending=[False, True]).itertuples(index=False):
            at = next((i for i, free in enumerate(room) if free >= r.length), None)
            if at is None:
                room.append(max(capacity - int(r.length), 0))
                at = len(room) - 1
            else:
                room[at] -= int(r.length)
            out.append((r.chunk, r.row_id, at, int(r.length)))
        return pd.DataFrame(out, columns=["chunk", "row_id", "bin", "length"])

    return run


def pck_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Records in chunks of 256 by id, each chunk packed into bins of 4096 words, first fit of decreasing length; longer ones stand alone."""
    from segloom.plans.sampling import pck_lengths

    rows = pck_lengths(spark, folder).withColumn("chunk", F.floor(F.col("row_id") / 256))
    return rows.groupBy("chunk").applyInPandas(_ffd(4096), "chunk long, row_id long, bin int, length long")


def flt_strict_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first 300 records by id whose conversion succeeds, with the number skipped before each."""
    from segloom.operators.chat import last_reply, messages

    rows = table(spark, folder, "train").dropDuplicates(["row_id"]).select("row_id", last_reply(messages(F.col("conversations"))).alias("a"))
    rows = sm.placed(rows.withColumn("good", F.coalesce(F.char_length("a") > 80, F.lit(False))), ["row_id"])
    good = sm.placed(rows.filter("good").select("row_id", F.col("rn").alias("place")), ["row_id"])
    return good.filter("rn < 300").select("row_id", (F.col("place") - F.col("rn")).alias("skipped"))


def flt_frame_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as frames: at most six objects, at most three attributes each, ids of one letter and up to three digits, one kind a pair."""
    li = table(spark, folder, "lineitem")
    obj = li.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("attributes"), F.concat(F.lit("o"), F.col("l_suppkey").cast("string")).alias("id"))
    return obj.groupBy("l_orderkey").agg(
        (F.count("*") > 6).alias("too_many_objects"), F.bool_or(F.col("attributes") > 3).alias("too_many_attributes"), F.bool_or(~F.col("id").rlike("^o[0-9]{1,3}$")).alias("bad_id")
    ).groupBy("too_many_objects", "too_many_attributes", "bad_id").agg(F.count("*").alias("n"))


def prj_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Contents as parts of text and media: the text with placeholders, and the number of media."""
    from segloom.operators.chat import messages

    m = messages(F.col("conversations"))
    parts = F.flatten(F.transform(m, lambda x: F.transform(F.split(F.coalesce(x["content"], F.lit("")), r"(?=<video>)|(?<=<video>)"), lambda p: F.struct(F.when(p == "<video>", "video").otherwise("text").alias("type"), p.alias("text")))))
    rows = table(spark, folder, "train").dropDuplicates(["row_id"]).filter("size(conversations) > 0").select("row_id", parts.alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return rows.select("row_id", F.md5(text).alias("text"), F.size(F.filter("p", lambda x: x["type"] == "video")).alias("videos"))


def prj_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Columns with a prefix as nested records; what the rejected one lacks it has from the chosen one."""
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("chosen_status"), F.col("o_orderpriority").alias("chosen_priority"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("rejected_status"),
    )
    fields = lambda prefix: {c[len(prefix) :]: F.col(c) for c in o.columns if c.startswith(prefix)}
    chosen, rejected = fields("chosen_"), fields("rejected_")
    inherit = {k: F.coalesce(rejected[k], v) if k in rejected else v for k, v in chosen.items()}
    rows = o.select("id", F.struct(*(v.alias(k) for k, v in chosen.items())).alias("chosen"), F.struct(*(v.alias(k) for k, v in inherit.items())).alias("rejected"))
    return rows.groupBy(F.col("chosen.status").alias("chosen"), F.col("rejected.priority").alias("rejected")).agg(F.count("*").alias("n"))


def prj_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Each answer's segments as lines of a prompt, and its first segment without the others."""
    rows = _lists(spark, folder).filter(F.forall("segments", lambda x: x["start_time"].isNotNull() & x["end_time"].isNotNull()))
    return rows.select("row_id", "turn_no", sg.listing(F.col("segments")).alias("listing"), sg.listing(F.slice("segments", 1, 1)).alias("first"))


def num_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each event as JSON with its members in order of name."""
    ev = table(spark, folder, "events")
    text = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","user_id":'), F.col("user_id").cast("string"), F.lit("}"))
    return ev.select("event_id", F.sha2(text, 256).alias("digest"))


def num_python_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Settings written with single quotes are read like JSON."""
    ev = table(spark, folder, "events")
    loose = F.from_json(F.replace("props", F.lit('"'), F.lit("'")), "k int", {"allowSingleQuotes": "true"})["k"]
    return ev.select("event_id", loose.alias("k"))


ORACLE = {
    "ref_merge_rescored": f"""with recursive {_LISTS},
r as (select row_id, turn_no, k, 0 as run, s, e, label, reason from l where k = 0
  union all
  select c.row_id, c.turn_no, c.k, case when c.label = r.label then r.run else r.run + 1 end, case when c.label = r.label then r.s else c.s end, c.e,
    case when c.label = r.label then case when length(concat_ws(' Then, ', r.reason, c.reason)) > 300 then 'Interest' else 'Joy' end else c.label end,
    case when c.label = r.label then concat_ws(' Then, ', r.reason, c.reason) else c.reason end
  from r join l c on c.row_id = r.row_id and c.turn_no = r.turn_no and c.k = r.k + 1)
select row_id, turn_no, cast(run as integer) as k, s, e, label, cast(length(reason) as integer) as n from (select *, row_number() over (partition by row_id, turn_no, run order by k desc) as z from r) where z = 1""",
    "ref_until_complete": """with m as (select distinct row_id, cast(round(video_duration * 1000) as bigint) as ms from manifest where video_duration > 0),
r as (select case when ms <= 10000 then 0 when ms // 2 <= 10000 then 1 when ms // 4 <= 10000 then 2 when ms // 8 <= 10000 then 3 else 4 end as rounds, ms from m)
select cast(rounds as integer) as rounds, count(*) as n, max(cast(floor(ms / pow(2, rounds)) as bigint)) as most from r group by 1""",
    "sta_unigram_overlap": """with s as (select distinct segment_id, event, reason from segments where event is not null and reason is not null),
a as (select segment_id, w, count(*) as n from (select segment_id, unnest(regexp_split_to_array(trim(event, ' '), '\\s+')) as w from s) group by 1, 2), b as (select segment_id, w, count(*) as n from (select segment_id, unnest(regexp_split_to_array(trim(reason, ' '), '\\s+')) as w from s) group by 1, 2),
c as (select coalesce(a.segment_id, b.segment_id) as segment_id, coalesce(a.n, 0) as x, coalesce(b.n, 0) as y from a full join b on a.segment_id = b.segment_id and a.w = b.w)
select segment_id, round(200 * sum(least(x, y)) / (sum(x) + sum(y)), 6) as rouge_1 from c group by 1""",
    "sta_divergence": """with e as (select vec_id, list_transform(embedding::double[], lambda x: x) as x from embeddings), t as (select vec_id, list_transform(x, lambda v: exp(v - list_max(x))) as x from e),
p as (select vec_id, list_transform(x, lambda v: v / list_sum(x)) as p from t), j as (select a.vec_id, unnest(a.p) as p, unnest(b.p) as q from p a join p b on b.vec_id = a.vec_id + 1)
select vec_id, round(sum(0.25 * p * ln(p / (0.25 * p + 0.75 * q)) + 0.75 * q * ln(q / (0.25 * p + 0.75 * q))), 6) as jsd from j group by 1""",
    "agg_masked_accuracy": """with r as (select l_orderkey, l_linenumber, case when l_linestatus = 'O' then 'N' else 'R' end as p, lead(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as y from lineitem),
g as (select l_orderkey, sum(case when p = y then 1 else 0 end) as h, count(*) as n from r where y is not null and l_linenumber % 4 <> 0 group by 1) select round(sum(h) / sum(n), 6) as token, round(avg(case when h = n then 1.0 else 0.0 end), 6) as sequence from g""",
    "flt_strict_rows": """with t as (select distinct row_id, list_filter(conversations, lambda t: t."from" = 'gpt') as g from train), a as (select row_id, coalesce(length(g[-1].value) > 80, false) as good from t),
p as (select *, row_number() over (order by row_id) - 1 as place from a), q as (select row_id, place, row_number() over (order by row_id) - 1 as rn from p where good) select row_id, place - rn as skipped from q where rn < 300""",
    "flt_frame_graph": """with o as (select l_orderkey, l_suppkey, count(*) as a from lineitem group by 1, 2),
f as (select l_orderkey, count(*) > 6 as too_many_objects, bool_or(a > 3) as too_many_attributes, bool_or(not regexp_full_match('o' || l_suppkey, 'o[0-9]{1,3}')) as bad_id from o group by 1)
select too_many_objects, too_many_attributes, bad_id, count(*) as n from f group by 1, 2, 3""",
    "prj_parts": """with t as (select distinct row_id, array_to_string(list_transform(conversations, lambda t: coalesce(t.value, '')), '') as v from train where len(conversations) > 0)
select row_id, md5(v) as text, cast(len(regexp_extract_all(v, '<video>')) as integer) as videos from t""",
    "prj_prefixes": "select o_orderstatus as chosen, o_orderpriority as rejected, count(*) as n from orders group by 1, 2",
    "prj_listing": f"""with {_LISTS}, t as (select *, 'Segment ' || k || ': [' || printf('%.1f', round(s, 1)) || 's, ' || printf('%.1f', round(e, 1)) || 's] ' || coalesce(label, 'none') as t from l)
select row_id, turn_no, string_agg(t, chr(10) order by k) as listing, any_value(t) filter (k = 0) as first from t group by 1, 2 having bool_and(s is not null and e is not null)
union all select row_id, turn_no, '', '' from l1 where json_array_length(j) = 0""",
    "num_canonical": """select event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') as digest from events""",
    "num_python_literals": "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events",
}

QUERIES = {
    f.__name__: f
    for f in (
        ref_merge_rescored, ref_until_complete, sta_overlap_scores, sta_unigram_overlap, sta_clusters, sta_divergence, agg_masked_accuracy, pck_bins, flt_strict_rows,
        flt_frame_graph, prj_parts, prj_prefixes, prj_listing, num_canonical, num_python_literals,
    )
}
