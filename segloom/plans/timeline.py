"""Queries on labelled timelines: islands, alignment, matching, tilings, validators and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions import intervals as iv
from segloom.operators import segments as sg
from segloom.operators.ordered import scan
from segloom.plans import problems
from segloom.plans.base import GT, PRED, SEG, gt, pred, seg
from segloom.session import durable, table

THRESHOLDS = (0.3, 0.5, 0.7, 0.9)
#: Width of the time buckets of interval joins, in milliseconds.
BUCKET = 20_000
# The labels.
VOCABULARY = (
    "Awkwardness,Empathic Pain,Fear,Anger,Sadness,Relief,Boredom,Joy,Aesthetic Appreciation,Adoration,Admiration,Amusement,Satisfaction,Disgust,"
    "Sexual Desire,Confusion,Romance,Craving,Horror,Excitement,Nostalgia,Awe (or Wonder),Interest,Calmness,Surprise,Entrancement,Anxiety"
).split(",")
_ITEM = "array<struct<start_time:string,end_time:string,start:string,end:string,emotion:string,reason:string>>"


def six(x):
    return F.round(x, 6)


def _paired(spark: SparkSession, folder: str) -> DataFrame:
    g = gt(spark, folder).select("entity", "idx", F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("label").alias("gl"))
    p = pred(spark, folder).select("entity", "idx", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("label").alias("pl"))
    return g.join(p, ["entity", "idx"]).withColumn("iou", iv.iou(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge")))


_PAIRED = PRED + """,
pairs as (select g.entity, g.idx, g.s as gs, g.e as ge, g.label as gl, p.s as ps, p.e as pe, p.label as pl,
  case when greatest(g.e, p.e) - least(g.s, p.s) > 0 then greatest(least(g.e, p.e) - greatest(g.s, p.s), 0) / (greatest(g.e, p.e) - least(g.s, p.s)) else 0.0 end as iou
  from gt g join pred p on g.entity = p.entity and g.idx = p.idx)"""


def seg_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one event type of a user."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("entity"), "event_id", F.col("event_type").alias("label"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), F.lit(1).alias("one")
    )
    rows = rows.withColumn("e", F.col("s"))
    return sg.islands(rows, "entity", ["s", "event_id"], "label").select(F.col("entity").alias("user_id"), "island", "label", "n", F.col("s").alias("first_us"), F.col("e").alias("last_us"))


def seg_positional_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs by place; per threshold the pairs that reach it and the share of equal labels among them."""
    each = F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold")
    rows = _paired(spark, folder).select("iou", (F.col("gl").eqNullSafe(F.col("pl"))).alias("same"), each)
    return rows.groupBy("threshold").agg(
        F.count("*").alias("pairs"),
        six(F.avg("iou")).alias("mean_iou"),
        F.count_if(F.col("iou") >= F.col("threshold")).alias("qualified"),
        F.count_if((F.col("iou") >= F.col("threshold")) & F.col("same")).alias("correct"),
        six(iv.safe_ratio(F.count_if((F.col("iou") >= F.col("threshold")) & F.col("same")), F.count_if(F.col("iou") >= F.col("threshold")))).alias("accuracy"),
    )


COUNTERS = _PAIRED + """,
a as (select entity, count(*) as gt from gt group by 1), b as (select entity, count(*) as pred from pred group by 1),
k as (select entity, count(*) as pairs, sum(iou) as iou_sum, count(*) filter (gl is not distinct from pl) as label_correct, count(*) filter (iou >= 0.5) as qualified,
  count(*) filter (iou >= 0.5 and gl is not distinct from pl) as joint, count(*) filter (iou >= 0.5 and (gl is not distinct from pl or idx % 2 = 0)) as joint_b from pairs group by 1),
n as (select entity, gt, coalesce(pred, 0) as pred, coalesce(pairs, 0) as pairs, coalesce(iou_sum, 0.0) as iou_sum, coalesce(label_correct, 0) as label_correct, coalesce(qualified, 0) as qualified,
  coalesce(joint, 0) as joint, coalesce(joint_b, 0) as joint_b, case when gt = coalesce(pred, 0) then 1 else 0 end as count_correct from a left join b using (entity) left join k using (entity))"""


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Additive counters of each clip with true segments, from one alignment of both sides by place."""
    g = gt(spark, folder).select("entity", "idx", F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("label").alias("gl"))
    p = pred(spark, folder).select("entity", "idx", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("label").alias("pl"))
    both = F.col("gs").isNotNull() & F.col("ps").isNotNull()
    rows = g.join(p, ["entity", "idx"], "full").withColumn("iou", F.when(both, iv.iou(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge"))))
    rows = rows.withColumn("same", both & F.col("gl").eqNullSafe(F.col("pl"))).withColumn("good", F.col("iou") >= 0.5)
    by = rows.groupBy("entity").agg(
        F.count("gs").alias("gt"), F.count("ps").alias("pred"), F.count("iou").alias("pairs"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou_sum"),
        F.count_if("same").alias("label_correct"), F.count_if("good").alias("qualified"), F.count_if(F.expr("good and same")).alias("joint"),
        F.count_if(F.col("good") & (F.col("same") | (both & (F.col("idx") % 2 == 0)))).alias("joint_b"),
    )
    return by.filter("gt > 0").withColumn("count_correct", (F.col("gt") == F.col("pred")).cast("long"))


def seg_eval_per_clip(spark: SparkSession, folder: str) -> DataFrame:
    """Per clip: counts of both sides, mean IoU and label accuracy of the pairs by place; 0 where there are none."""
    mean = lambda c: six(iv.safe_ratio(F.col(c), F.col("pairs")))
    return counters(spark, folder).select("entity", "gt", "pred", mean("iou_sum").alias("mean_iou"), mean("label_correct").alias("accuracy"), (F.col("count_correct") == 1).alias("count_match"))


def seg_eval_overall(spark: SparkSession, folder: str) -> DataFrame:
    """Over common clips only and over all clips: pooled means and the share of clips with equal counts."""
    by = counters(spark, folder)
    return by.agg(
        six(F.sum("iou_sum") / F.sum("pairs")).alias("micro_iou"),
        six(F.sum("label_correct") / F.sum("pairs")).alias("micro_accuracy"),
        F.count("*").alias("clips"),
        F.count_if(F.expr("pred = 0")).alias("missing"),
        six(F.avg(F.when(F.col("pred") > 0, F.col("count_correct").cast("double")))).alias("count_match_common"),
        six(F.avg(F.col("count_correct").cast("double"))).alias("count_match_all"),
        six(F.avg(six(iv.safe_ratio(F.col("iou_sum"), F.col("pairs"))))).alias("macro_iou"),
    )


def _best(spark: SparkSession, folder: str, by: str) -> DataFrame:
    p = pred(spark, folder).select("entity", F.col("idx").alias("i"), "s", "e", F.col("label").alias("pl"))
    g = gt(spark, folder).select("entity", F.col("idx").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("label").alias("gl"))
    return sg.best_match(p, g, BUCKET, by).filter("j is not null")


_MET = PRED + """,
met as (select p.entity, p.idx as i, g.idx as j, p.label as pl, g.label as gl, p.s, p.e, g.s as s2, g.e as e2,
  greatest(least(g.e, p.e) - greatest(g.s, p.s), 0) as common,
  greatest(least(g.e, p.e) - greatest(g.s, p.s), 0) / (greatest(g.e, p.e) - least(g.s, p.s)) as iou
  from pred p join gt g on p.entity = g.entity and p.s < g.e and g.s < p.e)"""


def seg_best_match_iou(spark: SparkSession, folder: str) -> DataFrame:
    """Each predicted segment's best true segment by IoU, with the boundary kernel; mean score per clip."""
    near = F.exp(-(F.abs(F.col("s") - F.col("s2")) + F.abs(F.col("e") - F.col("e2"))) / 1000.0 / 0.5)
    return _best(spark, folder, "iou").groupBy("entity").agg(F.count("*").alias("n"), six(F.avg(F.col("iou") * 0.5 + near * 0.5)).alias("score"))


def seg_best_match_label(spark: SparkSession, folder: str) -> DataFrame:
    """Share of predicted segments whose match by common length has its label and an IoU above one half."""
    hit = F.coalesce((F.col("pl") == F.col("gl")) & (F.col("iou") > 0.5), F.lit(False))
    return _best(spark, folder, "common").groupBy("entity").agg(F.count("*").alias("n"), six(F.avg(hit.cast("double"))).alias("score"))


_BEST = """,
r as (select *, row_number() over (partition by entity, i order by {by} desc, j) as k from met),
f as (select entity, min(idx) as fj from gt group by entity),
b as (select p.entity, p.idx as i, p.s, p.e, p.label as pl, coalesce(r.j, f.fj) as j, coalesce(r.iou, 0.0) as iou
  from pred p left join r on r.entity = p.entity and r.i = p.idx and r.k = 1 left join f on f.entity = p.entity),
x as (select b.*, g.s as s2, g.e as e2, g.label as gl from b join gt g on g.entity = b.entity and g.idx = b.j)"""


def seg_snap(spark: SparkSession, folder: str) -> DataFrame:
    """Starts of predicted segments moved to the nearest true start within half a second."""
    rows = pred(spark, folder).select("entity", "idx", F.col("s").alias("t"))
    return sg.snap(rows, gt(spark, folder).select("entity", F.col("s").alias("c")), 500)


def seg_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """How often a label follows another in a clip, and the probability given the first."""
    rows = scan(seg(spark, folder).filter("label is not null").select("entity", "s", "id", "label"), "entity", ["s", "id"], lags=["label"])
    n = rows.filter("prev_label is not null").groupBy(F.col("prev_label").alias("a"), F.col("label").alias("b")).agg(F.count("*").alias("n"))
    return n.withColumn("p", six(F.col("n") / F.sum("n").over(Window.partitionBy("a"))))


def seg_dwell(spark: SparkSession, folder: str) -> DataFrame:
    """Durations per label in seconds: count, mean, median and quantiles, shares of short ones."""
    rows = seg(spark, folder).select("label", ((F.col("e") - F.col("s")) / 1000.0).alias("d"))
    q = lambda p: six(F.percentile("d", p))
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), six(F.avg("d")).alias("mean"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), q(0.9).alias("q90"), q(0.95).alias("q95"),
        six(F.avg((F.col("d") <= 5).cast("double"))).alias("upto_5"), six(F.avg((F.col("d") <= 10).cast("double"))).alias("upto_10"),
    )


def seg_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """True and predicted label of pairs by place with IoU of one half or more: count, share of the row, three best examples."""
    named = lambda c: F.coalesce(c, F.lit("?"))
    rows = _paired(spark, folder).filter("iou >= 0.5").select(named("gl").alias("g"), named("pl").alias("p"), "entity", "idx", F.round("iou", 9).alias("iou"))
    top = Window.partitionBy("g", "p").orderBy(F.desc("iou"), "entity", "idx")  # only a top 3 is kept of each group, task by task
    best = rows.withColumn("k", F.row_number().over(top)).filter("k <= 3").groupBy("g", "p").agg(
        F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", "entity", F.col("idx").cast("string")).alias("x")))).alias("best")
    )
    by = rows.groupBy("g", "p").agg(F.count("*").alias("n")).join(best, ["g", "p"])
    return by.select("g", "p", "n", six(F.col("n") / F.sum("n").over(Window.partitionBy("g"))).alias("share"), F.array_join(F.transform("best", lambda x: x["x"]), ";").alias("examples"))


def seg_under_over(spark: SparkSession, folder: str) -> DataFrame:
    """Clips by number of true segments, and in all: fewer, as many, or more predicted, and their mean IoU; as grouping sets."""
    by = counters(spark, folder).withColumnRenamed("gt", "gt_count")
    return by.groupingSets([[F.col("gt_count")], []], "gt_count").agg(
        F.count("*").alias("clips"), F.count_if(F.expr("pred < gt_count")).alias("under"), F.count_if(F.expr("pred = gt_count")).alias("equal"), F.count_if(F.expr("pred > gt_count")).alias("over"),
        six(iv.safe_ratio(F.sum("iou_sum"), F.sum("pairs"))).alias("mean_iou"),
    )


def seg_sufficient_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Additive counters of the clips and the ratios made of their sums."""
    names = ("gt", "pred", "pairs", "iou_sum", "label_correct", "qualified", "joint", "count_correct")
    t = counters(spark, folder).agg(*(F.sum(c).alias(c) for c in names), F.count("*").alias("clips"), F.count_if(F.expr("pred > 0")).alias("valid"))
    r = lambda a, b: six(iv.safe_ratio(F.col(a), F.col(b)))
    return t.select(
        "clips", "gt", "pred", "pairs", "qualified", "joint", r("valid", "clips").alias("coverage"), r("iou_sum", "pairs").alias("mean_iou"), r("label_correct", "pairs").alias("label_accuracy"),
        r("joint", "qualified").alias("conditional_accuracy"), r("joint", "gt").alias("recall"), r("joint", "pred").alias("precision"),
        six(iv.safe_ratio(F.lit(2) * F.col("joint"), F.col("pred") + F.col("gt"))).alias("f1"),
        r("count_correct", "clips").alias("count_accuracy_all"), r("count_correct", "valid").alias("count_accuracy_valid"), r("joint", "pairs").alias("strict_accuracy"), r("iou_sum", "gt").alias("iou_per_gt"),
    )


def seg_evaluator(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of a maximum one-to-one matching at an IoU of one half, by label (``tp``) and without (``temporal_tp``)."""
    p = pred(spark, folder).select("entity", F.col("idx").alias("i"), "s", "e", F.col("label").alias("pl"))
    g = gt(spark, folder).select("entity", F.col("idx").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("label").alias("gl"))
    met = durable(sg.overlapping(p, g, BUCKET).filter(iv.iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")) >= 0.5))
    tp = sg.matched(met.filter(F.col("pl").eqNullSafe(F.col("gl"))).select("entity", "i", "j")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("tp"))
    temporal = sg.matched(met.select("entity", "i", "j")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("temporal_tp"))
    sides = [df.agg(F.count("*").alias(n)) for df, n in ((p, "pred"), (g, "gt"))]
    t = tp.join(F.broadcast(temporal)).join(F.broadcast(sides[0])).join(F.broadcast(sides[1]))  # one row each
    r = lambda a, b: six(iv.safe_ratio(F.col(a), F.col(b)))
    return t.select(
        "tp", "temporal_tp", "pred", "gt", r("tp", "pred").alias("matched_precision"), r("tp", "gt").alias("matched_recall"), r("temporal_tp", "gt").alias("temporal_recall"),
        six(iv.safe_ratio(2 * F.col("tp"), F.col("pred") + F.col("gt"))).alias("matched_f1"),
    )


def seg_matched_f1(spark: SparkSession, folder: str) -> DataFrame:
    """F1 of a maximum one-to-one matching of segments with one label and an IoU of one half or more."""
    p = pred(spark, folder).select("entity", F.col("idx").alias("i"), "s", "e", F.col("label").alias("pl"))
    g = gt(spark, folder).select("entity", F.col("idx").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("label").alias("gl"))
    met = sg.overlapping(p, g, BUCKET).filter(F.col("pl") == F.col("gl")).filter(iv.iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")) >= 0.5)
    tp = sg.matched(met.select("entity", "i", "j")).agg(F.sum("pairs").alias("tp"))
    np_, ng = (df.agg(F.count("*").alias(n)) for df, n in ((p, "pred"), (g, "gt")))
    return tp.join(F.broadcast(np_)).join(F.broadcast(ng)).select("tp", "pred", "gt", six(2 * F.col("tp") / (F.col("pred") + F.col("gt"))).alias("f1"))  # one row each


def seg_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Per clip the faults of its raw segments: without times, not positive, out of bounds of a known duration."""
    m = table(spark, folder, "manifest").filter("video_duration > 0").groupBy("video_id").agg(F.max("video_duration").alias("d"))
    rows = table(spark, folder, "segments").dropDuplicates(["segment_id"]).join(m, "video_id", "left")
    lost = F.col("start_time").isNull() | F.col("end_time").isNull() | F.isnan("start_time") | F.isnan("end_time")
    return rows.groupBy("video_id").agg(
        F.count("*").alias("n"), F.count_if(lost).alias("no_time"), F.count_if(~lost & (F.col("end_time") <= F.col("start_time"))).alias("not_positive"),
        F.count_if(~lost & ((F.col("start_time") < 0) | (F.col("end_time") > F.col("d") + 0.5))).alias("out_of_bounds"),
    )


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, turn_no, duration, segments`` of the answers with a whole JSON value, however it is wrapped."""
    c = F.posexplode("conversations").alias("turn_no", "t")
    rows = table(spark, folder, "train").select("row_id", F.coalesce(F.nullif("video_duration", F.lit(0.0)), F.lit(30.0)).alias("duration"), c)
    rows = rows.filter((F.col("t.from") == "gpt") & F.col("t.value").rlike(r"[\[{]"))
    text = F.regexp_replace("t.value", r"^\s*```[a-zA-Z]*\s*", "")
    text = F.when(F.startswith(F.ltrim(text), F.lit('"')), F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(text)
    rows = rows.withColumn("v", F.regexp_extract(text, r"(?s)[\[{].*[\]}]", 0))
    rows = rows.filter((F.col("v") != "") & F.try_parse_json(F.concat(F.lit("["), F.col("v"), F.lit("]"))).isNotNull())
    wrapped = F.from_json("v", f"struct<segments:{_ITEM},result:struct<segments:{_ITEM}>>")
    found = F.when(F.startswith("v", F.lit("[")), F.from_json("v", _ITEM)).otherwise(F.coalesce(wrapped["segments"], wrapped["result"]["segments"]))
    number = lambda x, c, other: F.coalesce(x[c], x[other]).try_cast("double").alias(c)  # noqa: E731  (times may be quoted)
    typed = lambda x: F.struct(number(x, "start_time", "start"), number(x, "end_time", "end"), x["emotion"].alias("emotion"), x["reason"].alias("reason"))
    parsed = rows.select("row_id", F.col("turn_no").cast("long").alias("turn_no"), "duration", F.transform(found, typed).alias("segments"), F.array_join(F.array_sort(F.json_object_keys("v")), ",").alias("keys"))
    return parsed.filter("segments is not null").dropDuplicates(["row_id", "turn_no"])


_LISTS = problems.VALUE + """,
l0 as (select distinct row_id, coalesce(nullif(video_duration, 0), 30.0) as duration from train),
l1 as (select row_id, turn_no, duration, l as j from s join l0 using (row_id) where json_type(l) = 'ARRAY'),
l2 as (select row_id, turn_no, duration, j, unnest(range(0, cast(json_array_length(j) as bigint))) as k from l1),
l as (select row_id, turn_no, duration, k, try_cast(coalesce(json_extract_string(j, '$[' || k || '].start_time'), json_extract_string(j, '$[' || k || '].start')) as double) as s,
  try_cast(coalesce(json_extract_string(j, '$[' || k || '].end_time'), json_extract_string(j, '$[' || k || '].end')) as double) as e, json_extract_string(j, '$[' || k || '].emotion') as label,
  json_extract_string(j, '$[' || k || '].reason') as reason from l2)"""


def seg_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Each answer's segments as a gap-free tiling of the clip."""
    rows = _lists(spark, folder).select("row_id", "turn_no", F.posexplode(sg.tile(F.col("segments"), F.col("duration"))).alias("k", "x"))
    return rows.select("row_id", "turn_no", "k", six("x.start_time").alias("s"), six("x.end_time").alias("e"), F.col("x.emotion").alias("label"))


def seg_merge_equal(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of one label merged, with their reasons."""
    rows = _lists(spark, folder).select("row_id", "turn_no", F.posexplode(sg.merge_equal(F.col("segments"))).alias("k", "x"))
    return rows.select("row_id", "turn_no", "k", F.col("x.start_time").alias("s"), F.col("x.end_time").alias("e"), F.col("x.emotion").alias("label"), F.coalesce("x.reason", F.lit("")).alias("reason"))


def seg_close_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Starts moved to the end before, the last end to the duration."""
    fixed = sg.close_gaps(F.col("segments"), F.col("duration"))
    rows = _lists(spark, folder).select("row_id", "turn_no", F.posexplode(fixed).alias("k", "x"))
    return rows.select("row_id", "turn_no", "k", F.col("x.start_time").alias("s"), F.col("x.end_time").alias("e"))


def seg_repair_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct labels of the segments and what they are repaired to."""
    return table(spark, folder, "segments").select("emotion").distinct().withColumn("repaired", sg.repair_label(F.col("emotion"), VOCABULARY))


def seg_first_fault(spark: SparkSession, folder: str) -> DataFrame:
    """The first rule that each answer breaks, under three strictnesses."""
    fault = lambda tolerance, decimals: F.coalesce(sg.first_fault(F.col("segments"), F.col("duration"), VOCABULARY, tolerance, decimals), F.lit("valid"))
    rows = _lists(spark, folder).select("row_id", "turn_no", fault(0.15, False).alias("training"), fault(0.051, True).alias("prediction"), fault(0.0001, True).alias("reward"))
    return rows.groupBy("training", "prediction", "reward").agg(F.count("*").alias("n"))


def seg_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as strict predictions: an object with ``segments`` and nothing else, whose list breaks no rule; else no prediction."""
    only = F.coalesce(F.col("keys") == "segments", F.lit(False))
    fault = F.coalesce(sg.first_fault(F.col("segments"), F.col("duration"), VOCABULARY, 0.051, True), F.lit("valid"))
    rows = _lists(spark, folder).select(only.alias("only_segments"), fault.alias("fault"))
    return rows.groupBy("only_segments", "fault").agg(F.count("*").alias("n")).withColumn("accepted", F.col("only_segments") & (F.col("fault") == "valid"))


def seg_aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Segments rebuilt between moved boundaries, each with the log of its left one: the clip's start, a cut, or where it was."""
    moved = durable(seg_snap(spark, folder))
    after = moved.select("entity", (F.col("idx") - 1).alias("idx"), F.col("aligned").alias("next"))
    own = pred(spark, folder).select("entity", "idx", "e")
    first = F.col("idx") == 0
    return moved.join(own, ["entity", "idx"]).join(after, ["entity", "idx"], "left").select(
        "entity", "idx", F.when(first, F.col("t")).otherwise(F.col("aligned")).alias("s"), F.coalesce("next", "e").alias("e"),
        F.when(first, "video_start").when(F.col("delta") != 0, "visual_cut").otherwise("event").alias("source"), F.when(first, 0).otherwise(F.col("delta")).alias("delta_to_cut"),
    )


def seg_iou_scalars(spark: SparkSession, folder: str) -> DataFrame:
    """IoU and common length of neighbours of one clip."""
    rows = scan(seg(spark, folder).select("entity", "s", "id", "e"), "entity", ["s", "id"], lags=["s", "e"]).filter("prev_s is not null")
    return rows.select("id", six(iv.iou(F.col("prev_s"), F.col("prev_e"), F.col("s"), F.col("e"))).alias("iou"), iv.overlap(F.col("prev_s"), F.col("prev_e"), F.col("s"), F.col("e")).alias("common"))


def seg_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled frame numbers of each clip, the frame in the middle, and the frames of its middle half."""
    m = table(spark, folder, "manifest").filter("video_duration > 0 and encoded_frames > 0").dropDuplicates(["row_id"])
    n, d = F.col("encoded_frames"), F.col("video_duration")
    span = iv.frame_range(d / 4, 3 * d / 4, n / d, n)
    return m.select(
        "row_id", F.array_join(iv.even_indices(n, F.lit(8)).cast("array<string>"), ",").alias("frames"), iv.middle_frame(F.lit(0.0), d, n / d, n).alias("middle"),
        span["first"].alias("first"), span["last"].alias("last"),
    )


def seg_subshots(spark: SparkSession, folder: str) -> DataFrame:
    """Per run of one event type of a user the event that changes least against its neighbours, the first on a tie."""
    keys = ["us", "event_id"]
    ev = table(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")
    rows = scan(ev, "user_id", keys, lags=["event_id", "event_type", "value"])
    rows = rows.withColumn("left", F.abs(F.col("value") - F.col("prev_value")))
    rows = rows.withColumn("change", F.when(F.col("prev_event_type").eqNullSafe(F.col("event_type")), 0).otherwise(1))
    after = rows.filter("prev_event_id is not null").select(F.col("prev_event_id").alias("event_id"), F.col("left").alias("right"))  # the next row's left is this one's right
    cost = F.coalesce((F.col("left") + F.col("right")) / 2, F.col("left"), F.col("right"), F.lit(0.0))
    runs = scan(rows.select("user_id", *keys, "left", "change"), "user_id", keys, sums=["change"]).join(after, "event_id", "left").withColumn("cost", F.round(cost, 6))
    best = runs.groupBy("user_id", F.col("run_change").alias("run")).agg(F.min(F.struct("cost", "us", "event_id")).alias("m"))
    return best.select("user_id", "run", F.col("m.event_id").alias("event_id"), F.col("m.cost").alias("cost"))


def seg_scene_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose value jumps by 50 or more against the user's event before, as distinct whole seconds."""
    rows = table(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    rows = scan(rows, "user_id", ["us", "event_id"], lags=["value"]).filter(F.abs(F.col("value") - F.col("prev_value")) >= 50)
    return rows.select("user_id", F.floor(F.col("us") / 1_000_000).alias("second")).distinct()


def seg_equal_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Control segmentations: as many equal parts as each answer has segments, and its first segment alone."""
    rows = _lists(spark, folder).withColumn("n", F.size("segments")).filter("n > 0")
    edge = lambda i: six(i * F.col("duration") / F.col("n"))
    parts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(edge(i).alias("s"), edge(i + 1).alias("e")))
    first = F.slice("segments", 1, 1)[0]
    return rows.select("row_id", "turn_no", first["end_time"].alias("first_end"), F.posexplode(parts).alias("k", "x")).select("row_id", "turn_no", "first_end", "k", "x.s", "x.e")


def seg_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Per place within the answers of the most frequent length the most frequent label, the first seen on a tie."""
    rows = _lists(spark, folder).withColumn("n", F.size("segments"))
    size = rows.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).select("n")
    each = rows.join(F.broadcast(size), "n").select("row_id", F.posexplode("segments").alias("k", "x"))
    by = each.groupBy("k", F.col("x.emotion").alias("label")).agg(F.count("*").alias("c"), F.min("row_id").alias("first"))
    return by.groupBy("k").agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "label")).alias("m")).select("k", F.col("m.label").alias("label"), (-F.col("m.c")).alias("n"))


def seg_modes_apart(spark: SparkSession, folder: str) -> DataFrame:
    """As ``seg_modes`` over answers of two segments or more, but no place repeats the label before it: it takes its most frequent other one."""
    rows = _lists(spark, folder).withColumn("n", F.size("segments")).filter("n > 1")
    size = rows.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).select("n")
    each = rows.join(F.broadcast(size), "n").select("row_id", F.posexplode("segments").alias("k", "x")).filter("x.emotion is not null")
    by = each.groupBy("k", F.col("x.emotion").alias("label")).agg(F.count("*").alias("c"), F.min("row_id").alias("first"))
    # A place can only lose the label before it, so its two best ones do: a row a place.
    order = Window.partitionBy("k").orderBy(F.desc("c"), "first", "label")
    two = by.withColumn("z", F.row_number().over(order)).filter("z <= 2").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("z", "label"))).alias("best"))
    places = two.agg(F.array_sort(F.collect_list(F.struct("k", F.transform("best", lambda b: b["label"]).alias("labels")))).alias("places"))
    start = F.array().cast("array<string>")

    def step(done, place):
        last = F.try_element_at(done, F.lit(-1))
        free = F.filter(place["labels"], lambda x: ~x.eqNullSafe(last))
        return F.concat(done, F.array(F.get(free, 0)))

    return places.select(F.posexplode(F.aggregate("places", start, step)).alias("k", "label"))


def seg_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Each segment and the one before it in its clip, as an edge."""
    rows = scan(seg(spark, folder).select("entity", "s", "id"), "entity", ["s", "id"], lags=["id"])
    return rows.filter("prev_id is not null").select(F.col("prev_id").alias("a"), F.lit("before").alias("relation"), F.col("id").alias("b"))


def seg_split_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per split of the manifest: clips, segments, mean duration of clips and segments."""
    m = table(spark, folder, "manifest").dropDuplicates(["row_id"]).select(F.col("video_id").alias("entity"), F.coalesce("split_name", F.lit("none")).alias("split"), F.when(F.col("video_duration") > 0, F.col("video_duration")).alias("d"))
    s = seg(spark, folder).groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("ms"))
    return m.join(s, "entity", "left").groupBy("split").agg(
        F.count("*").alias("clips"), F.coalesce(F.sum("n"), F.lit(0)).alias("segments"), six(F.avg("d")).alias("mean_clip"), six(F.sum("ms") / F.sum("n") / 1000.0).alias("mean_segment")
    )


_RUN = "row_number() over (partition by entity order by s, id)"
ORACLE = {
    "seg_islands": """with o as (select *, case when lag(event_type) over w is not distinct from event_type and lag(event_id) over w is not null then 0 else 1 end as c
  from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from o)
select user_id, cast(island as bigint) as island, event_type as label, count(*) as n, min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us from g group by 1, 2, 3""",
    "seg_positional_eval": f"""with {_PAIRED}, t as (select unnest([0.3, 0.5, 0.7, 0.9]) as threshold)
select cast(threshold as double) as threshold, count(*) as pairs, round(avg(iou), 6) as mean_iou, count(*) filter (iou >= threshold) as qualified,
  count(*) filter (iou >= threshold and gl is not distinct from pl) as correct,
  round(coalesce(count(*) filter (iou >= threshold and gl is not distinct from pl) / nullif(count(*) filter (iou >= threshold), 0), 0.0), 6) as accuracy
from pairs cross join t group by threshold""",
    "seg_eval_per_clip": f"""with {_PAIRED},
a as (select entity, count(*) as gt from gt group by entity), b as (select entity, count(*) as pred from pred group by entity),
c as (select entity, round(avg(iou), 6) as mean_iou, round(avg(case when gl is not distinct from pl then 1.0 else 0.0 end), 6) as accuracy from pairs group by entity)
select entity, gt, coalesce(pred, 0) as pred, coalesce(mean_iou, 0.0) as mean_iou, coalesce(accuracy, 0.0) as accuracy, gt = coalesce(pred, 0) as count_match
from a left join b using (entity) left join c using (entity)""",
    "seg_eval_overall": f"""with {_PAIRED},
a as (select entity, count(*) as gt from gt group by entity), b as (select entity, count(*) as pred from pred group by entity),
c as (select entity, round(avg(iou), 6) as mean_iou from pairs group by entity),
x as (select entity, gt, coalesce(pred, 0) as pred, coalesce(mean_iou, 0.0) as mean_iou from a left join b using (entity) left join c using (entity)),
y as (select round(avg(iou), 6) as micro_iou, round(avg(case when gl is not distinct from pl then 1.0 else 0.0 end), 6) as micro_accuracy from pairs)
select y.*, count(*) as clips, count(*) filter (pred = 0) as missing, round(avg(case when pred > 0 then case when gt = pred then 1.0 else 0.0 end end), 6) as count_match_common,
  round(avg(case when gt = pred then 1.0 else 0.0 end), 6) as count_match_all, round(avg(mean_iou), 6) as macro_iou from x cross join y group by all""",
    "seg_best_match_iou": f"""with {_MET}{_BEST.format(by="iou")}
select entity, count(*) as n, round(avg(iou * 0.5 + exp(-(abs(s - s2) + abs(e - e2)) / 1000.0 / 0.5) * 0.5), 6) as score from x group by entity""",
    "seg_best_match_label": f"""with {_MET}{_BEST.format(by="common")}
select entity, count(*) as n, round(avg(case when pl = gl and iou > 0.5 then 1.0 else 0.0 end), 6) as score from x group by entity""",
    "seg_snap": f"""with {PRED}, c as (select distinct entity, s as c from gt),
n as (select p.entity, p.idx, p.s as t, c.c, row_number() over (partition by p.entity, p.idx order by abs(c.c - p.s), c.c) as k
  from pred p left join c on c.entity = p.entity and abs(c.c - p.s) <= 500)
select entity, idx, t, coalesce(c, t) as aligned, coalesce(c - t, 0) as delta from n where k = 1""",
    "seg_aligned": f"""with {PRED}, c as (select distinct entity, s as c from gt),
n as (select p.entity, p.idx, p.s as t, p.e, c.c, row_number() over (partition by p.entity, p.idx order by abs(c.c - p.s), c.c) as k from pred p left join c on c.entity = p.entity and abs(c.c - p.s) <= 500),
m as (select entity, idx, t, e, coalesce(c, t) as aligned, coalesce(c - t, 0) as delta from n where k = 1)
select entity, idx, case when idx = 0 then t else aligned end as s, coalesce(lead(aligned) over (partition by entity order by idx), e) as e,
  case when idx = 0 then 'video_start' when delta <> 0 then 'visual_cut' else 'event' end as source, case when idx = 0 then 0 else delta end as delta_to_cut from m""",
    "seg_strict": f"""with {_LISTS}, o as (select row_id, turn_no, coalesce(case when json_type(j) = 'OBJECT' then array_to_string(list_sort(json_keys(j)), ',') end = 'segments', false) as only_segments from v3),
x as (select *, lag(e) over w as pe, lag(label) over w as pl, lag(k) over w as pk, lead(k) over w as nk from l window w as (partition by row_id, turn_no order by k)),
b as (select row_id, turn_no, case when bool_or(coalesce(not (e > s), true)) then 'order' when bool_or(coalesce(abs(s - pe) > 0.051, pk is not null)) then 'continuity'
    when bool_or(label is null or label not in ({", ".join(f"'{v}'" for v in VOCABULARY)})) then 'label' when bool_or(trim(coalesce(reason, '')) = '') then 'reason'
    when bool_or(coalesce(label = pl, pk is not null)) then 'repeated' when bool_or(not (abs(s - round(s, 1)) < 1e-6 and abs(e - round(e, 1)) < 1e-6)) then 'decimals'
    when bool_or((pk is null and abs(s) > 0.051) or (nk is null and abs(e - duration) > 0.051)) then 'coverage' else 'valid' end as fault from x group by row_id, turn_no
  union all select row_id, turn_no, 'empty' from l1 where json_array_length(j) = 0)
select only_segments, fault, count(*) as n, only_segments and fault = 'valid' as accepted from b join o using (row_id, turn_no) group by 1, 2""",
    "seg_transitions": f"""with {SEG}, o as (select label as b, lag(label) over (partition by entity order by s, id) as a from seg where label is not null),
n as (select a, b, count(*) as n from o where a is not null group by a, b)
select a, b, n, round(n / sum(n) over (partition by a), 6) as p from n""",
    "seg_dwell": f"""with {SEG}, d as (select label, (e - s) / 1000.0 as d from seg)
select label, count(*) as n, round(avg(d), 6) as mean, round(quantile_cont(d, 0.5), 6) as median, round(quantile_cont(d, 0.25), 6) as q25, round(quantile_cont(d, 0.75), 6) as q75,
  round(quantile_cont(d, 0.9), 6) as q90, round(quantile_cont(d, 0.95), 6) as q95, round(avg(case when d <= 5 then 1.0 else 0.0 end), 6) as upto_5,
  round(avg(case when d <= 10 then 1.0 else 0.0 end), 6) as upto_10 from d group by label""",
    "seg_confusion": f"""with {_PAIRED}, x as (select coalesce(gl, '?') as g, coalesce(pl, '?') as p, entity, idx, iou,
  row_number() over (partition by coalesce(gl, '?'), coalesce(pl, '?') order by round(iou, 9) desc, entity, idx) as k from pairs where iou >= 0.5),
n as (select g, p, count(*) as n, string_agg(entity || ':' || idx, ';' order by k) filter (k <= 3) as examples from x group by g, p)
select g, p, n, round(n / sum(n) over (partition by g), 6) as share, examples from n""",
    "seg_under_over": f"""with {COUNTERS}
select gt as gt_count, count(*) as clips, count(*) filter (pred < gt) as under, count(*) filter (pred = gt) as "equal", count(*) filter (pred > gt) as "over",
  coalesce(round(sum(iou_sum) / nullif(sum(pairs), 0), 6), 0.0) as mean_iou from n group by grouping sets ((gt), ())""",
    "seg_sufficient_stats": f"""with {COUNTERS},
t as (select count(*) as clips, count(*) filter (pred > 0) as valid, sum(gt) as gt, sum(pred) as pred, sum(pairs) as pairs, sum(iou_sum) as iou_sum, sum(label_correct) as label_correct,
  sum(qualified) as qualified, sum(joint) as joint, sum(count_correct) as count_correct from n)
select clips, cast(gt as bigint) as gt, cast(pred as bigint) as pred, cast(pairs as bigint) as pairs, cast(qualified as bigint) as qualified, cast(joint as bigint) as joint, round(valid / clips, 6) as coverage,
  round(iou_sum / pairs, 6) as mean_iou, round(label_correct / pairs, 6) as label_accuracy, round(joint / qualified, 6) as conditional_accuracy, round(joint / gt, 6) as recall, round(joint / pred, 6) as precision,
  round(2 * joint / (pred + gt), 6) as f1, round(count_correct / clips, 6) as count_accuracy_all, round(count_correct / valid, 6) as count_accuracy_valid, round(joint / pairs, 6) as strict_accuracy,
  round(iou_sum / gt, 6) as iou_per_gt from t""",
    "seg_flags": """with m as (select video_id, max(video_duration) as d from manifest where video_duration > 0 group by video_id),
r as (select distinct segment_id, video_id, start_time, end_time from segments),
x as (select r.*, d, start_time is null or end_time is null or isnan(start_time) or isnan(end_time) as lost from r left join m using (video_id))
select video_id, count(*) as n, count(*) filter (lost) as no_time, count(*) filter (not lost and end_time <= start_time) as not_positive,
  count(*) filter (not lost and (start_time < 0 or end_time > d + 0.5)) as out_of_bounds from x group by video_id""",
    "seg_tiling": f"""with recursive {_LISTS},
f as (select row_id, turn_no, duration, least(greatest(s, 0.0), duration) as s, least(greatest(e, 0.0), duration) as e, label, reason from l where e > s and not isnan(s) and not isnan(e)),
o as (select *, row_number() over w as k, count(*) over (partition by row_id, turn_no) as n from f where e > s window w as (partition by row_id, turn_no order by s, e, label nulls first, reason nulls first)),
r as (select row_id, turn_no, cast(0 as bigint) as k, cast(null as double) as s, cast(0.0 as double) as e, cast(null as varchar) as label from (select distinct row_id, turn_no from o)
  union all
  select o.row_id, o.turn_no, o.k, r.e, case when o.k = o.n then o.duration
    else least(greatest(round(o.e, 1), round(r.e + 0.1, 1)), round(o.duration - (o.n - o.k) * 0.1, 1)) end, o.label
  from r join o on o.row_id = r.row_id and o.turn_no = r.turn_no and o.k = r.k + 1)
select row_id, turn_no, cast(k - 1 as integer) as k, round(s, 6) as s, round(e, 6) as e, label from r where k > 0
union all select row_id, turn_no, 0, 0.0, duration, null from (select distinct row_id, turn_no, duration from l1) x where not exists (select 1 from o where o.row_id = x.row_id and o.turn_no = x.turn_no)""",
    "seg_merge_equal": f"""with recursive {_LISTS}, c as (select *, lead(k) over (partition by row_id, turn_no order by k) as nk from l),
r as (select row_id, turn_no, k, 0 as run, s, e, label, reason from l where k = 0
  union all
  select c.row_id, c.turn_no, c.k, case when c.label is not distinct from r.label then r.run else r.run + 1 end,
    case when c.label is not distinct from r.label then r.s else c.s end, c.e, c.label,
    case when c.label is distinct from r.label then c.reason
      when coalesce(c.reason, '') = '' or contains(coalesce(r.reason, ''), c.reason) then coalesce(r.reason, '')
      when coalesce(r.reason, '') = '' then c.reason else r.reason || ' ' || c.reason end
  from r join l c on c.row_id = r.row_id and c.turn_no = r.turn_no and c.k = r.k + 1)
select row_id, turn_no, cast(run as integer) as k, s, e, label, coalesce(reason, '') as reason from (select *, row_number() over (partition by row_id, turn_no, run order by k desc) as z from r) where z = 1""",
    "seg_close_gaps": f"""with {_LISTS}, x as (select *, lag(e) over (partition by row_id, turn_no order by k) as pe, lead(k) over (partition by row_id, turn_no order by k) as nk from l)
select row_id, turn_no, cast(k as integer) as k, case when k = 0 then 0.0 else pe end as s, case when nk is null and abs(e - duration) > 0.5 then duration else e end as e from x""",
    "seg_repair_labels": f"""with v as (select unnest(range(1, {len(VOCABULARY) + 1})) as i, unnest([{", ".join(f"'{x}'" for x in VOCABULARY)}]) as v),
d as (select distinct emotion from segments),
n as (select emotion, first(v order by i) as f from d join v on contains(lower(v), lower(coalesce(emotion, ''))) or contains(lower(coalesce(emotion, '')), lower(v)) group by emotion)
select d.emotion, case when d.emotion in (select v from v) then d.emotion else coalesce(f, 'Interest') end as repaired from d left join n on n.emotion is not distinct from d.emotion""",
    "seg_first_fault": f"""with {_LISTS}, x as (select *, lag(e) over w as pe, lag(label) over w as pl, lag(k) over w as pk, lead(k) over w as nk from l window w as (partition by row_id, turn_no order by k)),
t as (select unnest([0.15, 0.051, 0.0001]) as tol, unnest([0, 1, 1]) as dec),
b as (select row_id, turn_no, tol,
  case when bool_or(coalesce(not (e > s), true)) then 'order'
    when bool_or(coalesce(abs(s - pe) > tol, pk is not null)) then 'continuity'
    when bool_or(label is null or label not in ({", ".join(f"'{v}'" for v in VOCABULARY)})) then 'label'
    when bool_or(trim(coalesce(reason, '')) = '') then 'reason'
    when bool_or(coalesce(label = pl, pk is not null)) then 'repeated'
    when bool_or(dec = 1 and not (abs(s - round(s, 1)) < 1e-6 and abs(e - round(e, 1)) < 1e-6)) then 'decimals'
    when bool_or((pk is null and abs(s) > tol) or (nk is null and abs(e - duration) > tol)) then 'coverage' else 'valid' end as fault
  from x cross join t group by row_id, turn_no, tol, dec),
q as (select row_id, turn_no, max(fault) filter (tol = 0.15) as training, max(fault) filter (tol = 0.051) as prediction, max(fault) filter (tol = 0.0001) as reward from b group by row_id, turn_no
  union all select row_id, turn_no, 'empty', 'empty', 'empty' from l1 where json_array_length(j) = 0)
select training, prediction, reward, count(*) as n from q group by all""",
    "seg_iou_scalars": f"""with {SEG}, x as (select *, lag(s) over w as ps, lag(e) over w as pe from seg window w as (partition by entity order by s, id))
select id, round(greatest(least(e, pe) - greatest(s, ps), 0) / (greatest(e, pe) - least(s, ps)), 6) as iou, greatest(least(e, pe) - greatest(s, ps), 0) as common from x where ps is not null""",
    "seg_frames": """with m as (select distinct row_id, encoded_frames as n, video_duration as d from manifest where video_duration > 0 and encoded_frames > 0),
f as (select row_id, string_agg(cast(i as varchar), ',' order by i2) as frames from (select row_id, i2,
  case when n <= 8 then i2 else cast(floor(i2 * (n - 1) / 7) as integer) end as i from m cross join (select unnest(range(0, 8)) as i2) where n > 8 or i2 < n) group by row_id),
x as (select row_id, n, greatest(0, least(n - 1, cast(ceil(d / 4 * (n / d)) as integer))) as a, greatest(0, least(n - 1, cast(floor(3 * d / 4 * (n / d)) as integer))) as b,
  least(n - 1, greatest(0, cast(floor((0.0 + d) / 2 * (n / d)) as integer))) as middle from m)
select row_id, frames, middle, case when a < b then a end as first, case when a < b then b end as last from x join f using (row_id)""",
    "seg_subshots": """with a as (select *, abs(value - lag(value) over w) as l, abs(lead(value) over w - value) as r,
  case when lag(event_type) over w is not distinct from event_type then 0 else 1 end as c from events window w as (partition by user_id order by ts, event_id)),
b as (select *, round(coalesce((l + r) / 2, l, r, 0.0), 6) as cost, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from a),
k as (select *, row_number() over (partition by user_id, run order by cost, ts, event_id) as k from b)
select user_id, cast(run as bigint) as run, event_id, cost from k where k = 1""",
    "seg_scene_cuts": """with a as (select *, lag(value) over (partition by user_id order by ts, event_id) as p from events)
select distinct user_id, cast(floor(epoch_us(ts) / 1000000) as bigint) as second from a where abs(value - p) >= 50""",
    "seg_equal_bins": f"""with {_LISTS}, n as (select row_id, turn_no, duration, count(*) as n, max(e) filter (k = 0) as first_end from l group by all)
select row_id, turn_no, first_end, cast(k as integer) as k, round(k * duration / n, 6) as s, round((k + 1) * duration / n, 6) as e from n join (select row_id, turn_no, k from l) using (row_id, turn_no)""",
    "seg_modes": f"""with {_LISTS}, n as (select row_id, turn_no, count(*) as n from l group by all),
m as (select n from n group by n order by count(*) desc, n limit 1),
c as (select k, label, count(*) as c, min(row_id) as f from l join n using (row_id, turn_no) where n in (select n from m) group by k, label),
r as (select *, row_number() over (partition by k order by c desc, f, label nulls first) as z from c)
select cast(k as integer) as k, label, c as n from r where z = 1""",
    "seg_modes_apart": f"""with recursive {_LISTS}, n as (select row_id, turn_no, count(*) as n from l group by all having count(*) > 1), m as (select n from n group by n order by count(*) desc, n limit 1),
c as (select k, label, count(*) as c, min(row_id) as f from l join n using (row_id, turn_no) where n in (select n from m) and label is not null group by k, label),
r as (select *, row_number() over (partition by k order by c desc, f, label) as z from c),
w as (select k, label from r where k = 0 and z = 1 union all
  select b.k, case when b.label <> w.label then b.label else d.label end from w join r b on b.k = w.k + 1 and b.z = 1 left join r d on d.k = w.k + 1 and d.z = 2)
select cast(k as integer) as k, label from w""",
    "seg_chain": f"""with {SEG}, x as (select id as b, lag(id) over (partition by entity order by s, id) as a from seg) select a, 'before' as relation, b from x where a is not null""",
    "seg_split_stats": f"""with {SEG}, m as (select distinct row_id, video_id as entity, coalesce(split_name, 'none') as split, case when video_duration > 0 then video_duration end as d from manifest),
s as (select entity, count(*) as n, sum(e - s) as ms from seg group by entity)
select split, count(*) as clips, cast(coalesce(sum(n), 0) as bigint) as segments, round(avg(d), 6) as mean_clip, round(sum(ms) / sum(n) / 1000.0, 6) as mean_segment from m left join s using (entity) group by split""",
}

QUERIES = {
    f.__name__: f
    for f in (
        seg_islands, seg_positional_eval, seg_eval_per_clip, seg_eval_overall, seg_best_match_iou, seg_best_match_label, seg_snap, seg_transitions, seg_dwell, seg_confusion,
        seg_under_over, seg_sufficient_stats, seg_evaluator, seg_matched_f1, seg_flags, seg_tiling, seg_merge_equal, seg_close_gaps, seg_repair_labels, seg_first_fault, seg_strict, seg_aligned, seg_iou_scalars,
        seg_frames, seg_subshots, seg_scene_cuts, seg_equal_bins, seg_modes, seg_modes_apart, seg_chain, seg_split_stats,
    )
}
