"""Queries of intervals and tests: bootstraps over clips, paired differences, exact tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions import statistics as st
from segloom.functions.intervals import safe_ratio
from segloom.operators import resampling as rs
from segloom.plans.timeline import COUNTERS, counters, six
from segloom.session import durable, table

SEED = 41
STATS = ["gt", "pred", "pairs", "iou_sum", "qualified", "joint", "joint_b", "count_correct", "clips"]
#: Metrics as numerator over denominator, both sums of STATS.
RATIOS = {"conditional_accuracy": ("joint", "qualified"), "recall": ("joint", "gt"), "mean_iou": ("iou_sum", "pairs"), "count_accuracy": ("count_correct", "clips"), "joint_f1": ("2 * joint", "pred + gt")}
#: Differences of the second arm from the first.
CONTRASTS = {"recall": ("joint_b", "joint", "gt"), "joint_f1": ("2 * joint_b", "2 * joint", "pred + gt")}


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return durable(counters(spark, folder).withColumn("clips", F.lit(1)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(six(c).alias(c) if k == "double" else c for c, k in df.dtypes))


def bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Five metrics of the evaluation with their 95 and 90 % intervals, 2,000 repetitions over clips."""
    metrics = {m: F.expr(f"({a}) / greatest({b}, 1)") for m, (a, b) in RATIOS.items()}
    return _rounded(rs.intervals(_units(spark, folder), "entity", metrics, STATS, 2000, SEED))


def bootstrap_contrast(spark: SparkSession, folder: str) -> DataFrame:
    """Paired differences of two arms of predictions over the same clips, 5,000 repetitions, and whether they are practically nil."""
    metrics = {m: F.expr(f"({b}) / greatest({d}, 1) - ({a}) / greatest({d}, 1)") for m, (b, a, d) in CONTRASTS.items()}
    rows = rs.intervals(_units(spark, folder), "entity", metrics, STATS, 5000, SEED)
    return _rounded(rows.withColumn("equivalent", st.within(F.col("low_90"), F.col("high_90"), 0.05)))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Clips with long answers or not under both of the two most frequent models, by kind of prompt."""
    o = table(spark, folder, "outputs").filter("raw_output is not null and model is not null and video_id is not null and prompt_kind is not null")
    top = Window.orderBy(F.desc("n"), "model")  # a row a model
    models = o.select("output_id", "model").distinct().groupBy("model").agg(F.count("*").alias("n")).withColumn("arm", F.row_number().over(top)).filter("arm <= 2")
    y = o.groupBy("model", "prompt_kind", "video_id").agg(F.max((F.char_length("raw_output") > 600).cast("int")).alias("y")).join(F.broadcast(models.select("model", "arm")), "model")
    return y.groupBy("prompt_kind", "video_id").agg(F.max(F.when(F.col("arm") == 1, F.col("y"))).alias("a"), F.max(F.when(F.col("arm") == 2, F.col("y"))).alias("b")).filter("a is not null and b is not null")


def paired_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The two arms' agreement table over all kinds, the mean difference with its bootstrap interval and the exact McNemar probability."""
    rows = durable(_pairs(spark, folder).select(F.concat_ws("|", "prompt_kind", "video_id").alias("unit"), "a", "b", F.lit(1).alias("n"), (F.col("a") - F.col("b")).alias("d")))
    ci = rs.intervals(rows, "unit", {"difference": F.expr("d / greatest(n, 1)")}, ["d", "n"], 5000, SEED, (0.95,))
    t = rows.agg(
        F.count("*").alias("n"), F.count_if(F.expr("a = 1 and b = 1")).alias("both"), F.count_if(F.expr("a = 1 and b = 0")).alias("a_only"), F.count_if(F.expr("a = 0 and b = 1")).alias("b_only"),
        F.count_if(F.expr("a = 0 and b = 0")).alias("neither"), (F.min("d") == F.max("d")).alias("degenerate"),
    )
    t = t.withColumn("p", st.mcnemar(F.col("a_only"), F.col("b_only")))
    return t.join(F.broadcast(ci)).select("n", "both", "a_only", "b_only", "neither", six("estimate").alias("difference"), six("low_95").alias("low"), six("high_95").alias("high"), "degenerate", six("p").alias("p"))


def binomial_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source of the manifest the clips without a usable duration, the Wilson interval, and the exact chance of so many at a rate of 5 %."""
    rows = table(spark, folder, "manifest").dropDuplicates(["row_id"])
    bad = F.coalesce((F.col("video_duration") <= 0) | F.isnan("video_duration"), F.lit(True))
    by = rows.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.count_if(bad).alias("k"))
    w = st.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return by.select("source", "n", "k", six(w["low"]).alias("low"), six(w["high"]).alias("high"), six(st.binomial_upper(F.col("k"), F.col("n"), 0.05)).alias("p"))


def split_distributions(spark: SparkSession, folder: str) -> DataFrame:
    """Per split of the manifest: segments, clips, durations of segments (mean, median, quartiles, 90 and 95 %), words of reasons, segments per clip."""
    m = table(spark, folder, "manifest").select("video_id", F.coalesce("split_name", F.lit("none")).alias("split")).distinct()
    s = table(spark, folder, "segments").filter("not isnan(start_time) and not isnan(end_time) and end_time > start_time").dropDuplicates(["segment_id"])
    rows = s.join(m, "video_id").select("split", "video_id", F.round(F.col("end_time") - F.col("start_time"), 3).alias("d"), F.size(F.split(F.trim("reason"), r"\s+")).alias("w"))
    q = lambda p, n: six(F.percentile("d", p)).alias(n)
    by = rows.groupBy("split").agg(F.count("*").alias("segments"), F.countDistinct("video_id").alias("clips"), six(F.avg("d")).alias("mean"), q(0.5, "median"), q(0.25, "low"), q(0.75, "high"), q(0.9, "p90"), q(0.95, "p95"))
    words = rows.filter("w > 0").groupBy("split").agg(six(F.avg("w")).alias("words"), six(F.percentile("w", 0.5)).alias("median_words"))
    return by.join(words, "split", "left").withColumn("per_clip", six(F.col("segments") / F.col("clips")))


_REPS = lambda reps, units, key, columns: rs.sql_draws(reps, SEED, units, key, columns)
_WIDE = ", ".join(f"cast({c} as double) as {c}" for c in STATS if c != "clips")
_UNITS = COUNTERS + f", u as (select entity, {_WIDE}, 1.0::double as clips from n)"
_SUMS = ", ".join(f"sum({c} * w) as {c}" for c in STATS)
_CUT = "quantile_cont(x, 0.025) as low_95, quantile_cont(x, 0.975) as high_95, quantile_cont(x, 0.05) as low_90, quantile_cont(x, 0.95) as high_90, count(*) as repetitions"
_LONG = lambda metrics, source: " union all ".join(f"select '{m}' as metric, {e} as x from {source}" for m, e in metrics.items())
_ONE = {m: f"({a}) / greatest({b}, 1)" for m, (a, b) in RATIOS.items()}
_TWO = {m: f"({b}) / greatest({d}, 1) - ({a}) / greatest({d}, 1)" for m, (b, a, d) in CONTRASTS.items()}


def _interval_sql(reps: int, metrics: dict[str, str], last: str) -> str:
    return f"""with {_UNITS},
{_REPS(reps, "u", "entity", ["entity", *STATS])},
r as (select rep, {_SUMS} from b2 group by rep), p as (select {", ".join(f"sum({c}) as {c}" for c in STATS)} from u),
x as ({_LONG(metrics, "r")}), e as ({_LONG(metrics, "p")}), c as (select metric, {_CUT} from x group by metric)
select metric, round(e.x, 6) as estimate, round(low_95, 6) as low_95, round(high_95, 6) as high_95, round(low_90, 6) as low_90, round(high_90, 6) as high_90, repetitions{last} from e join c using (metric)"""


ORACLE = {
    "bootstrap": _interval_sql(2000, _ONE, ""),
    "bootstrap_contrast": _interval_sql(5000, _TWO, ", low_90 > -0.05 and high_90 < 0.05 as equivalent"),
    "paired_difference": f"""with o as (select * from outputs where raw_output is not null and model is not null and video_id is not null and prompt_kind is not null),
m as (select model, row_number() over (order by count(distinct output_id) desc, model) as arm from o group by model),
y as (select arm, prompt_kind, video_id, max(case when length(raw_output) > 600 then 1 else 0 end) as y from o join m using (model) where arm <= 2 group by 1, 2, 3),
v as (select prompt_kind || '|' || video_id as unit, max(y) filter (arm = 1) as a, max(y) filter (arm = 2) as b from y group by prompt_kind, video_id having max(y) filter (arm = 1) is not null and max(y) filter (arm = 2) is not null),
u as (select unit, a, b, a - b as d from v),
{_REPS(5000, "u", "unit", ["unit", "d"])},
r as (select rep, sum(d * w) / greatest(sum(w), 1)::double as x from b2 group by rep), c as (select quantile_cont(x, 0.025) as low, quantile_cont(x, 0.975) as high from r),
t as (select count(*) as n, count(*) filter (a = 1 and b = 1) as "both", count(*) filter (a = 1 and b = 0) as a_only, count(*) filter (a = 0 and b = 1) as b_only, count(*) filter (a = 0 and b = 0) as neither,
  avg(d) as difference, min(d) = max(d) as degenerate from u),
i as (select unnest(range(0, least(a_only, b_only) + 1)) as i from t),
s as (select sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0))) as tail from i cross join t)
select n, "both", a_only, b_only, neither, round(difference, 6) as difference, round(low, 6) as low, round(high, 6) as high, degenerate, round(case when a_only + b_only = 0 then 1.0 else least(1.0, 2 * tail) end, 6) as p
from t cross join c cross join s""",
    "binomial_rates": f"""with m as (select distinct row_id, source, video_duration as d from manifest), g as (select coalesce(source, 'none') as source, count(*) as n, count(*) filter (coalesce(d <= 0 or isnan(d), true)) as k from m group by 1),
i as (select source, n, k, unnest(range(k, n + 1)) as i from g),
b as (select source, any_value(n) as n, any_value(k) as k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95))) as p from i group by source),
w as (select *, cast(k as double) / n as r, {st.Z95} as z from b)
select source, n, k, round(greatest(0.0, (r + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) as low,
  round(least(1.0, (r + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) as high, round(least(1.0, p), 6) as p from w""",
    "split_distributions": """with m as (select distinct video_id, coalesce(split_name, 'none') as split from manifest),
s as (select distinct segment_id, video_id, start_time, end_time, reason from segments where not isnan(start_time) and not isnan(end_time) and end_time > start_time),
r as (select split, video_id, round(end_time - start_time, 3) as d, len(string_split_regex(trim(reason), '\\s+')) as w from s join m using (video_id)),
g as (select split, avg(w) filter (w > 0) as words, quantile_cont(w, 0.5) filter (w > 0) as median_words, count(*) as segments, count(distinct video_id) as clips, avg(d) as mean, quantile_cont(d, 0.5) as median,
  quantile_cont(d, 0.25) as low, quantile_cont(d, 0.75) as high, quantile_cont(d, 0.9) as p90, quantile_cont(d, 0.95) as p95 from r group by split)
select split, segments, clips, round(mean, 6) as mean, round(median, 6) as median, round(low, 6) as low, round(high, 6) as high, round(p90, 6) as p90, round(p95, 6) as p95, round(words, 6) as words,
  round(median_words, 6) as median_words, round(segments / clips, 6) as per_clip from g""",
}
QUERIES = {f.__name__: f for f in (bootstrap, bootstrap_contrast, paired_difference, binomial_rates, split_distributions)}
