"""Queries on groups of scored samples: advantages, selections, agreement, ranking and embedding metrics.

Carriers: the lines of an order are the samples of a prompt, with discount, tax and quantity as rewards; the embeddings
with even and odd numbers are pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions import statistics as st
from segloom.operators import groups as gr
from segloom.operators.ordered import scan, smoothed
from segloom.session import table

WEIGHTS = (0.5, 0.3, 0.2)


def six(x):
    return F.round(x, 6)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("prompt"), F.col("l_linenumber").alias("sample"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_discount").alias("r1"), F.col("l_tax").alias("r2"), F.when(F.col("l_quantity") > 5, F.col("l_quantity") / 50).alias("r3"),
    )
    return rows.withColumn("r", gr.weighted_sum([F.col("r1"), F.col("r2"), F.col("r3")], list(WEIGHTS)))


_LINES = """l as (select l_orderkey as prompt, l_linenumber as sample, l_partkey as part, l_suppkey as supp, l_discount as r1, l_tax as r2,
  case when l_quantity > 5 then l_quantity / 50 end as r3 from lineitem),
x as (select *, r1 * 0.5 + r2 * 0.3 + coalesce(r3, 0) * 0.2 as r from l),
w as (select *, avg(r) over p as m, coalesce(stddev_samp(r) over p, 0) as sd, count(*) over p as n from x window p as (partition by prompt))"""


def adv_group(spark: SparkSession, folder: str) -> DataFrame:
    """Reward less the mean of its group, unscaled, and scaled by the deviation of the group."""
    rows = gr.with_stats(_lines(spark, folder), "prompt", "r")
    a = gr.centred(F.col("r"))
    return rows.select("prompt", "sample", "part", "supp", six("r").alias("r"), six(a).alias("a"), six(gr.scaled(a, F.col("group_std"))).alias("scaled"))


def adv_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    rows = gr.with_stats(_lines(spark, folder), "prompt", "r")
    return rows.select("prompt", "sample", "part", "supp", six(gr.leave_one_out(F.col("r"))).alias("a"))


def adv_batch_scaled(spark: SparkSession, folder: str) -> DataFrame:
    """Centred by group, scaled by the deviation of all rewards."""
    rows = gr.with_stats(_lines(spark, folder), "prompt", "r")
    every = rows.agg(F.stddev_samp("r").alias("sd"))
    return rows.join(F.broadcast(every)).select("prompt", "sample", "part", "supp", six(gr.scaled(gr.centred(F.col("r")), F.col("sd"))).alias("a"))


def adv_whitened(spark: SparkSession, folder: str) -> DataFrame:
    """Centred by group, then whitened over all."""
    rows = gr.with_stats(_lines(spark, folder), "prompt", "r").withColumn("a", gr.centred(F.col("r")))
    every = rows.agg(F.avg("a").alias("m"), F.stddev_samp("a").alias("sd"))
    return rows.join(F.broadcast(every)).select("prompt", "sample", "part", "supp", six((F.col("a") - F.col("m")) / (F.col("sd") + 1e-4)).alias("a"))


def adv_per_reward(spark: SparkSession, folder: str) -> DataFrame:
    """Every reward normalised within its group, their weighted sum normalised over all."""
    rows = _lines(spark, folder)
    for c in ("r1", "r2", "r3"):
        rows = gr.with_stats(rows, "prompt", c).withColumn(f"z{c}", gr.scaled(gr.centred(F.col(c)), F.col("group_std"))).drop(*gr.STATS)
    rows = rows.withColumn("a", gr.weighted_sum([F.col("zr1"), F.col("zr2"), F.col("zr3")], list(WEIGHTS)))
    every = rows.agg(F.avg("a").alias("m"), F.stddev_samp("a").alias("sd"))
    return rows.join(F.broadcast(every)).select("prompt", "sample", "part", "supp", F.round((F.col("a") - F.col("m")) / (F.col("sd") + 1e-8), 5).alias("a"))


def adv_per_request(spark: SparkSession, folder: str) -> DataFrame:
    """The last line of a supplier within an order stands for its request; statistics are over requests."""
    last = gr.last_per(_lines(spark, folder).select("prompt", "supp", "sample", "part", "r"), ["prompt", "supp"], ["sample", "part"])
    rows = gr.with_stats(last, "prompt", "r")
    return rows.select("prompt", "supp", "sample", six(gr.scaled(gr.centred(F.col("r")), F.col("group_std"))).alias("a"))


def reward_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the group means and deviations, and the share of groups without any."""
    by = _lines(spark, folder).groupBy("prompt").agg(F.avg("r").alias("m"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"))
    return by.agg(F.count("*").alias("groups"), six(F.avg("m")).alias("mean"), six(F.avg("sd")).alias("deviation"), six(F.avg((F.col("sd") < 1e-8).cast("double"))).alias("flat"))


def reward_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, sample and population deviation, extremes of each reward, missing ones left out."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ("r1", "r2", "r3")))).alias("x")
    rows = _lines(spark, folder).select(each).select("x.name", "x.v")
    return rows.groupBy("name").agg(
        F.count("v").alias("n"), six(F.avg("v")).alias("mean"), six(F.stddev_samp("v")).alias("sample_sd"), six(F.stddev_pop("v")).alias("population_sd"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def varied_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose lines have different discounts."""
    return gr.varied(_lines(spark, folder), "prompt", "r1").groupBy("prompt").agg(F.count("*").alias("n"))


def best_of_n(spark: SparkSession, folder: str) -> DataFrame:
    """Per order the two best lines by score, against its worst; groups of one score are left out."""
    rows = _lines(spark, folder).select("prompt", "sample", "part", "supp", F.round(F.col("r1") + 10 * F.col("r2"), 6).alias("score"))
    best = Window.partitionBy("prompt").orderBy(F.desc("score"), "sample", "part", "supp")
    worst = gr.first_per(rows, ["prompt"], ["score", "sample", "part", "supp"]).select("prompt", F.col("sample").alias("worst"), F.col("score").alias("worst_score"))
    top = rows.withColumn("rank", F.row_number().over(best)).filter("rank <= 2")
    return top.join(worst, "prompt").filter("score > worst_score").select("prompt", "rank", "sample", "score", "worst", "worst_score")


def minmax(spark: SparkSession, folder: str) -> DataFrame:
    """Rewards scaled to [0, 1] within their order; those of a constant group are 0, or 1 at most."""
    by = _lines(spark, folder)
    ends = by.groupBy("prompt").agg(F.min("r").alias("a"), F.max("r").alias("b"))
    x = F.when(F.col("b") > F.col("a"), (F.col("r") - F.col("a")) / (F.col("b") - F.col("a") + 1e-5)).when(F.col("r") > 0, F.least(F.lit(1.0), F.col("r"))).otherwise(0.0)
    return by.join(ends, "prompt").select("prompt", "sample", "part", "supp", six(x).alias("x"))


def rotated(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in batches of eight by id; each is paired with the one before it in its batch, the first with the last."""
    rows = table(spark, folder, "documents").select("doc_id", F.floor((F.col("doc_id") - 1) / 8).alias("batch"))
    w = Window.partitionBy("batch").orderBy("doc_id")  # a batch has eight ids at most
    last = F.last("doc_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("doc_id", "batch", F.coalesce(F.lag("doc_id").over(w), last).alias("paired"))


def early_stop(spark: SparkSession, folder: str) -> DataFrame:
    """Per user, events since the best value so far: the best grows only, so its first event is the least place that has it."""
    keys = ["us", "event_id"]
    rows = table(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", F.lit(1).alias("one"))
    rows = scan(rows, "user_id", keys, sums=["one"], tops=["value"]).select("user_id", "event_id", F.col("run_one").alias("n"), F.col("top_value").alias("best"))
    since = rows.filter("best is not null").groupBy("user_id", "best").agg(F.min("n").alias("mark"))
    return rows.join(since, ["user_id", "best"], "left").select("user_id", "event_id", (F.col("n") - F.col("mark")).cast("long").alias("since_best"))


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    pair = F.floor(F.col("vec_id") / 2)
    side = lambda odd: e.filter(F.col("vec_id") % 2 == odd)
    left = side(0).select(pair.alias("pair"), F.col("embedding").alias("a"), F.col("label").alias("la"))
    right = side(1).select(pair.alias("pair"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    rows = left.join(right, "pair")
    return rows.select(
        "pair", F.when(F.col("la") == F.col("lb"), 1.0).otherwise(0.0).alias("same"), F.round(st.cosine(F.col("a"), F.col("b")), 9).alias("cosine"),
        F.round(-st.euclid(F.col("a"), F.col("b")), 9).alias("euclid"), F.round(-st.manhattan(F.col("a"), F.col("b")), 9).alias("manhattan"), F.round(st.dot(F.col("a"), F.col("b")), 9).alias("dot"),
    )


_EMBEDDED = """v as (select a.vec_id // 2 as pair, case when a.label = b.label then 1.0::double else 0.0::double end as same, a.embedding::double[] as a, b.embedding::double[] as b
  from embeddings a join embeddings b on a.vec_id % 2 = 0 and b.vec_id = a.vec_id + 1),
z as (select pair, same, round(list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)), 9) as cosine, round(-list_distance(a, b), 9) as euclid,
  round(-list_sum(list_transform(range(1, len(a)::bigint + 1), lambda i: abs(a[i] - b[i]))), 9) as manhattan, round(list_inner_product(a, b), 9) as dot from v)"""


def pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Four similarities of each pair of embeddings."""
    return _embedded(spark, folder)


def pair_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Pearson and Spearman correlation of four similarities with the sameness of labels; ties have their mean rank."""
    names = ("cosine", "euclid", "manhattan", "dot")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in names))).alias("x")
    rows = _embedded(spark, folder).select("pair", "same", each).select("pair", "same", "x.measure", "x.v")
    # Mean ranks out of counts per value: a running sum over the distinct values of a measure.
    ranked = rows
    for c, r in (("v", "rv"), ("same", "rs")):
        counts = rows.groupBy("measure", c).agg(F.count("*").alias("n"))
        ranks = scan(counts, "measure", [c], sums=["n"]).select("measure", c, (F.col("run_n") - (F.col("n") - 1) / 2).alias(r))
        ranked = ranked.join(ranks, ["measure", c])
    return ranked.groupBy("measure").agg(six(F.corr("v", "same")).alias("pearson"), six(F.corr("rv", "rs")).alias("spearman"))


def pair_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Mean squared distance of cosine and label, and contrastive loss with the margin one half."""
    d = 1 - F.col("cosine")
    loss = 0.5 * (F.col("same") * d * d + (1 - F.col("same")) * F.pow(F.greatest(F.lit(0.0), 0.5 - d), 2))
    return _embedded(spark, folder).agg(six(F.avg(F.pow(F.col("cosine") - F.col("same"), 2))).alias("cosine_mse"), six(F.avg(loss)).alias("contrastive"))


def pair_hard_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Contrastive loss of the hard pairs: equal ones farther apart than the nearest unequal pair, unequal ones nearer than the farthest equal pair."""
    rows = _embedded(spark, folder).select("same", F.round(1 - F.col("cosine"), 9).alias("d"))
    equal = lambda f, n: f(F.when(F.col("same") == n, F.col("d")))
    edge = rows.agg(equal(F.max, 1).alias("far"), equal(F.avg, 1).alias("mean_equal"), equal(F.min, 0).alias("near"), equal(F.avg, 0).alias("mean_other"))
    far, near = F.coalesce("far", "mean_other"), F.coalesce("near", "mean_equal")
    rows = rows.join(F.broadcast(edge))  # one row
    pos, neg = (F.col("same") == 1) & (F.col("d") > near), (F.col("same") == 0) & (F.col("d") < far)
    return rows.agg(
        F.count_if(pos).alias("equal"), F.count_if(neg).alias("other"),
        six(F.coalesce(F.sum(F.when(pos, F.col("d") * F.col("d"))), F.lit(0.0)) + F.coalesce(F.sum(F.when(neg, F.pow(F.greatest(F.lit(0.0), 0.5 - F.col("d")), 2))), F.lit(0.0))).alias("loss"),
    )


def batch_margin(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of eight pairs: similarity of the own partner less that of the nearest other one, and the in-batch loss."""
    e = table(spark, folder, "embeddings").select((F.floor(F.col("vec_id") / 16)).alias("batch"), F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).alias("odd"), "embedding")
    left = e.filter("odd = 0").select("batch", F.col("pair").alias("i"), F.col("embedding").alias("a"))
    right = e.filter("odd = 1").select("batch", F.col("pair").alias("j"), F.col("embedding").alias("b"))
    rows = left.join(right, "batch").select("i", "j", st.cosine(F.col("a"), F.col("b")).alias("c"))  # eight by eight a batch
    by = rows.groupBy("i").agg(
        F.max(F.when(F.col("i") == F.col("j"), F.col("c"))).alias("own"), F.max(F.when(F.col("i") != F.col("j"), F.col("c"))).alias("other"),
        F.avg(F.when(F.col("i") != F.col("j"), F.col("c"))).alias("others"), F.ln(F.sum(F.exp(F.col("c")))).alias("all"),
    ).filter("own is not null")
    return by.agg(F.count("*").alias("n"), six(F.avg(F.col("own") - F.col("other"))).alias("margin"), six(F.avg("own")).alias("own"), six(F.avg("others")).alias("others"), six(F.avg(F.col("all") - F.col("own"))).alias("loss"))


def ranking(spark: SparkSession, folder: str) -> DataFrame:
    """MRR and NDCG of orders as queries: lines by discount (tie: line), relevant where returned; queries of two lines or more with a hit."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_discount", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("rel"))
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_linenumber", "l_partkey")
    ideal = Window.partitionBy("l_orderkey").orderBy(F.desc("rel"))
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("ik", F.row_number().over(ideal))
    by = rows.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("k"))).alias("first"),
        F.sum(F.col("rel") / F.log2(F.col("k") + 1)).alias("dcg"), F.sum(F.col("rel") / F.log2(F.col("ik") + 1)).alias("best"),
    ).filter("n >= 2 and hits > 0")
    return by.agg(F.count("*").alias("queries"), six(F.avg(1 / F.col("first"))).alias("mrr"), six(F.avg(F.col("dcg") / F.col("best"))).alias("ndcg"))


def marked_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Events in order, a purchase starting a group: the running count of purchases is the group; size of each."""
    rows = table(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "purchase").cast("int").alias("mark"))
    return scan(rows, "user_id", ["us", "event_id"], sums=["mark"]).filter("run_mark > 0").groupBy("user_id", F.col("run_mark").alias("part")).agg(F.count("*").alias("n"))


def wilson_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of returned lines per supplier with its Wilson interval."""
    by = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    w = st.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return by.select("l_suppkey", "n", "k", six(w["low"]).alias("low"), six(w["high"]).alias("high"))


def paired_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Two models per condition and clip: agreement table, exact McNemar probability, adjusted by Holm's steps."""
    o = table(spark, folder, "outputs").filter("raw_output is not null").groupBy("model", "prompt_kind", "video_id").agg(F.max((F.char_length("raw_output") > 600).cast("int")).alias("y"))
    side = lambda m, c: o.filter(F.col("model") == m).select("prompt_kind", "video_id", F.col("y").alias(c))
    rows = side("peer_vl", "a").join(side("peer_small", "b"), ["prompt_kind", "video_id"])
    t = rows.groupBy("prompt_kind").agg(F.count_if(F.expr("a = 1 and b = 1")).alias("both"), F.count_if(F.expr("a = 1 and b = 0")).alias("a_only"), F.count_if(F.expr("a = 0 and b = 1")).alias("b_only"), F.count_if(F.expr("a = 0 and b = 0")).alias("neither"))
    t = t.withColumn("p", st.mcnemar(F.col("a_only"), F.col("b_only")))
    order = Window.orderBy("p", "prompt_kind")  # one row a condition
    m = t.agg(F.count("*").alias("m"))
    t = t.join(F.broadcast(m)).withColumn("step", F.least(F.lit(1.0), F.col("p") * (F.col("m") - F.row_number().over(order) + 1)))
    return t.select("prompt_kind", "both", "a_only", "b_only", "neither", six("p").alias("p"), six(F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("holm"))


def label_events(spark: SparkSession, folder: str) -> DataFrame:
    """Per source of the manifest the share of natural clips, of all and of those with a kind, plus a four-way count."""
    rows = table(spark, folder, "manifest").dropDuplicates(["row_id"])
    return rows.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count("*").alias("n"), F.count_if(F.expr("kind is null")).alias("unknown"), F.count_if(F.expr("kind = 'natural'")).alias("natural"),
        six(F.count_if(F.expr("kind = 'natural'")) / F.count("*")).alias("of_all"), six(F.try_divide(F.count_if(F.expr("kind = 'natural'")), F.count("kind"))).alias("of_known"),
    )


def smoothing(spark: SparkSession, folder: str) -> DataFrame:
    """Exponentially smoothed values of each user's events."""
    rows = table(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    return smoothed(rows, "user_id", ["us", "event_id"], "value", 0.9).select("user_id", "event_id", six("smooth").alias("x"))


def softmax_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy of the softmax of each embedding's components."""
    return table(spark, folder, "embeddings").select("vec_id", six(st.entropy(F.transform("embedding", lambda x: x.cast("double")))).alias("entropy"))


def importance(spark: SparkSession, folder: str) -> DataFrame:
    """Per order as a sequence of lines: log ratios of two rewards clamped, geometric mean ratio, KL terms; truncated and masked weights; effective sample size."""
    rows = _lines(spark, folder).select("prompt", (F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.ln(F.col("r1") + 0.05) - F.ln(F.col("r2") + 0.05)))).alias("d"))
    by = rows.groupBy("prompt").agg(F.avg("d").alias("m"), F.avg(F.exp("d") - 1 - F.col("d")).alias("k3"), F.avg(F.least(F.exp("d"), F.lit(2.0))).alias("token"), F.avg(F.when(F.exp("d") <= 2, F.exp("d")).otherwise(0.0)).alias("masked"))
    by = by.withColumn("w", F.least(F.exp("m"), F.lit(2.0)))
    return by.agg(
        F.count("*").alias("n"), six(F.avg("k3")).alias("k3"), six(F.avg("token")).alias("token"), six(F.avg("masked")).alias("masked"), six(F.avg("w")).alias("sequence"),
        six(F.avg((F.exp("m") > 2).cast("double"))).alias("clipped"), six(F.pow(F.avg("w"), 2) / F.avg(F.col("w") * F.col("w"))).alias("effective"), six(F.avg(F.pow(F.exp("m") - 1, 2))).alias("chi2"),
    )


def perplexities(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sequences of log probabilities of two policies: mean perplexities, difference and ratio of the logs, KL and its k3 form, chi square a token and a sequence."""
    clamp = lambda x: F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))
    rows = _lines(spark, folder).select("prompt", F.ln(F.col("r1") + 0.05).alias("a"), F.ln(F.col("r2") + 0.05).alias("b")).withColumn("d", clamp(F.col("a") - F.col("b")))
    by = rows.groupBy("prompt").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg(-F.col("d")).alias("kl"), F.avg(F.exp("d") - F.col("d") - 1).alias("k3"), F.avg(F.exp(2 * F.col("d"))).alias("chi"), F.avg("d").alias("m"))
    return by.agg(
        six(F.avg(F.exp(-F.col("a")))).alias("perplexity"), six(F.avg(F.exp(-F.col("b")))).alias("rollout_perplexity"), six(F.avg(F.col("b") - F.col("a"))).alias("log_difference"),
        six(F.avg(F.abs(F.col("b") - F.col("a")))).alias("abs_difference"), six(F.max(F.col("b") - F.col("a"))).alias("most"), six(F.min(F.col("b") - F.col("a"))).alias("least"),
        six(F.avg(F.exp(F.col("b") - F.col("a")))).alias("ratio"), six(F.avg("kl")).alias("kl"), six(F.avg("k3")).alias("k3"), six(F.avg("chi") - 1).alias("chi_token"), six(F.avg(F.exp(2 * F.col("m"))) - 1).alias("chi_sequence"),
    )


def off_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Lines left out where the mean difference of their order is above the limit and their advantage is negative."""
    rows = gr.with_stats(_lines(spark, folder), "prompt", "r").withColumn("a", gr.centred(F.col("r")))
    by = rows.groupBy("prompt").agg(F.avg(F.col("r1") - F.col("r2")).alias("d"))
    rows = rows.join(by, "prompt").withColumn("masked", (F.col("d") > 0.02) & (F.round("a", 9) < 0))
    return rows.groupBy("masked").agg(F.count("*").alias("n"))


def chunk_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks (ship modes of lines by flag and status) merged: a size-weighted and an unweighted mean, extremes."""
    by = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("size"), F.avg("l_discount").alias("v"), F.min("l_tax").alias("a"), F.max("l_tax").alias("b"))
    return by.agg(six(F.sum(F.col("v") * F.col("size")) / F.sum("size")).alias("weighted"), six(F.avg("v")).alias("unweighted"), F.min("a").alias("low"), F.max("b").alias("high"))


_ROWS = "prompt, sample, part, supp"
ORACLE = {
    "adv_group": f"with {_LINES} select {_ROWS}, round(r, 6) as r, round(r - m, 6) as a, round((r - m) / (sd + 1e-4), 6) as scaled from w",
    "adv_leave_one_out": f"with {_LINES} select {_ROWS}, round(case when n > 1 then (r - m) * n / (n - 1) else 0.0 end, 6) as a from w",
    "adv_batch_scaled": f"with {_LINES}, g as (select stddev_samp(r) as g from x) select {_ROWS}, round((r - m) / (g + 1e-4), 6) as a from w cross join g",
    "adv_whitened": f"with {_LINES}, g as (select avg(r - m) as gm, stddev_samp(r - m) as gs from w) select {_ROWS}, round((r - m - gm) / (gs + 1e-4), 6) as a from w cross join g",
    "adv_per_reward": f"""with {_LINES},
z as (select *, (r1 - avg(r1) over p) / (coalesce(stddev_samp(r1) over p, 0) + 1e-4) as z1, (r2 - avg(r2) over p) / (coalesce(stddev_samp(r2) over p, 0) + 1e-4) as z2,
  (r3 - avg(r3) over p) / (coalesce(stddev_samp(r3) over p, 0) + 1e-4) as z3 from x window p as (partition by prompt)),
s as (select *, z1 * 0.5 + z2 * 0.3 + coalesce(z3, 0) * 0.2 as a0 from z), g as (select avg(a0) as m, stddev_samp(a0) as sd from s)
select {_ROWS}, round((a0 - m) / (sd + 1e-8), 5) as a from s cross join g""",
    "adv_per_request": f"""with {_LINES}, q as (select *, row_number() over (partition by prompt, supp order by sample desc, part desc) as k from x),
u as (select prompt, supp, sample, r, avg(r) over p as m, coalesce(stddev_samp(r) over p, 0) as sd from q where k = 1 window p as (partition by prompt))
select prompt, supp, sample, round((r - m) / (sd + 1e-4), 6) as a from u""",
    "reward_groups": f"""with {_LINES}, g as (select prompt, avg(r) as m, coalesce(stddev_samp(r), 0) as sd from x group by prompt)
select count(*) as groups, round(avg(m), 6) as mean, round(avg(sd), 6) as deviation, round(avg(case when sd < 1e-8 then 1.0 else 0.0 end), 6) as flat from g""",
    "reward_columns": f"""with {_LINES}, e as (select 'r1' as name, r1 as v from x union all select 'r2', r2 from x union all select 'r3', r3 from x)
select name, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sample_sd, round(stddev_pop(v), 6) as population_sd, min(v) as low, max(v) as high from e group by name""",
    "varied_groups": f"with {_LINES} select prompt, count(*) as n from x group by prompt having min(r1) < max(r1)",
    "best_of_n": f"""with {_LINES}, s as (select prompt, sample, part, supp, round(r1 + 10 * r2, 6) as score from x),
k as (select *, row_number() over (partition by prompt order by score desc, sample, part, supp) as rank, row_number() over (partition by prompt order by score, sample, part, supp) as low from s)
select a.prompt, cast(a.rank as integer) as rank, a.sample, a.score, b.sample as worst, b.score as worst_score from k a join k b on a.prompt = b.prompt and b.low = 1 where a.rank <= 2 and a.score > b.score""",
    "minmax": f"""with {_LINES}, e as (select *, min(r) over p as a, max(r) over p as b from x window p as (partition by prompt))
select {_ROWS}, round(case when b > a then (r - a) / (b - a + 1e-5) when r > 0 then least(1.0, r) else 0.0 end, 6) as x from e""",
    "rotated": """select doc_id, cast((doc_id - 1) // 8 as bigint) as batch, coalesce(lag(doc_id) over (partition by (doc_id - 1) // 8 order by doc_id), max(doc_id) over (partition by (doc_id - 1) // 8)) as paired from documents""",
    "early_stop": """with a as (select user_id, event_id, ts, value, row_number() over w as n, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as best
  from events window w as (partition by user_id order by ts, event_id)),
b as (select *, max(case when best is null or value > best then n end) over (partition by user_id order by ts, event_id rows unbounded preceding) as best_n from a)
select user_id, event_id, cast(n - best_n as bigint) as since_best from b""",
    "pair_scores": f"with {_EMBEDDED} select * from z",
    "pair_correlation": f"""with {_EMBEDDED}, e as (unpivot z on cosine, euclid, manhattan, dot into name measure value v),
r as (select *, rank() over (partition by measure order by v) + (count(*) over (partition by measure, v) - 1) / 2.0 as rv, rank() over (partition by measure order by same) + (count(*) over (partition by measure, same) - 1) / 2.0 as rs from e)
select measure, round(corr(v, same), 6) as pearson, round(corr(rv, rs), 6) as spearman from r group by measure""",
    "pair_losses": f"""with {_EMBEDDED} select round(avg((cosine - same) ** 2), 6) as cosine_mse,
  round(avg(0.5 * (same * (1 - cosine) ** 2 + (1 - same) * greatest(0.0, 0.5 - (1 - cosine)) ** 2)), 6) as contrastive from z""",
    "pair_hard_losses": f"""with {_EMBEDDED}, d as (select same, round(1 - cosine, 9) as d from z),
e as (select coalesce(max(d) filter (same = 1), avg(d) filter (same = 0)) as far, coalesce(min(d) filter (same = 0), avg(d) filter (same = 1)) as near from d)
select count(*) filter (same = 1 and d > near) as "equal", count(*) filter (same = 0 and d < far) as other,
  round(coalesce(sum(d * d) filter (same = 1 and d > near), 0.0) + coalesce(sum(greatest(0.0, 0.5 - d) ** 2) filter (same = 0 and d < far), 0.0), 6) as loss from d cross join e""",
    "perplexities": f"""with {_LINES}, t as (select prompt, ln(r1 + 0.05) as a, ln(r2 + 0.05) as b from x), d as (select *, greatest(-20.0, least(20.0, a - b)) as d from t),
g as (select prompt, avg(a) as a, avg(b) as b, avg(-d) as kl, avg(exp(d) - d - 1) as k3, avg(exp(2 * d)) as chi, avg(d) as m from d group by prompt)
select round(avg(exp(-a)), 6) as perplexity, round(avg(exp(-b)), 6) as rollout_perplexity, round(avg(b - a), 6) as log_difference, round(avg(abs(b - a)), 6) as abs_difference, round(max(b - a), 6) as most, round(min(b - a), 6) as least,
  round(avg(exp(b - a)), 6) as ratio, round(avg(kl), 6) as kl, round(avg(k3), 6) as k3, round(avg(chi) - 1, 6) as chi_token, round(avg(exp(2 * m)) - 1, 6) as chi_sequence from g""",
    "batch_margin": """with e as (select vec_id // 16 as batch, vec_id // 2 as pair, vec_id % 2 as odd, embedding::double[] as v from embeddings),
c as (select a.pair as i, b.pair as j, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) as c from e a join e b on a.batch = b.batch and a.odd = 0 and b.odd = 1),
g as (select i, max(c) filter (i = j) as own, max(c) filter (i <> j) as other, avg(c) filter (i <> j) as others, ln(sum(exp(c))) as "all" from c group by i having max(c) filter (i = j) is not null)
select count(*) as n, round(avg(own - other), 6) as margin, round(avg(own), 6) as own, round(avg(others), 6) as others, round(avg("all" - own), 6) as loss from g""",
    "ranking": """with r as (select l_orderkey, case when l_returnflag = 'R' then 1 else 0 end as rel, row_number() over (partition by l_orderkey order by l_discount desc, l_linenumber, l_partkey) as k,
  row_number() over (partition by l_orderkey order by case when l_returnflag = 'R' then 1 else 0 end desc) as ik from lineitem),
g as (select l_orderkey, count(*) as n, sum(rel) as hits, min(k) filter (rel = 1) as first, sum(rel / log2(k + 1)) as dcg, sum(rel / log2(ik + 1)) as best from r group by l_orderkey)
select count(*) as queries, round(avg(1 / first), 6) as mrr, round(avg(dcg / best), 6) as ndcg from g where n >= 2 and hits > 0""",
    "marked_groups": """with g as (select user_id, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as part from events)
select user_id, cast(part as bigint) as part, count(*) as n from g where part > 0 group by 1, 2""",
    "wilson_rates": f"""with g as (select l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'R') as k from lineitem group by l_suppkey),
w as (select *, cast(k as double) / n as p, {st.Z95} as z from g)
select l_suppkey, n, k, round(greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) as low,
  round(least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) as high from w""",
    "paired_tests": """with o as (select model, prompt_kind, video_id, max(case when length(raw_output) > 600 then 1 else 0 end) as y from outputs where raw_output is not null group by 1, 2, 3),
r as (select a.prompt_kind, a.y as a, b.y as b from o a join o b on a.model = 'peer_vl' and b.model = 'peer_small' and a.prompt_kind = b.prompt_kind and a.video_id = b.video_id),
t as (select prompt_kind, count(*) filter (a = 1 and b = 1) as "both", count(*) filter (a = 1 and b = 0) as a_only, count(*) filter (a = 0 and b = 1) as b_only, count(*) filter (a = 0 and b = 0) as neither from r group by 1),
i as (select prompt_kind, unnest(range(0, least(a_only, b_only) + 1)) as i from t),
s as (select prompt_kind, sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0))) as tail from i join t using (prompt_kind) group by 1),
p as (select t.*, case when a_only + b_only = 0 then 1.0 else least(1.0, 2 * tail) end as p from t join s using (prompt_kind)),
h as (select *, least(1.0, p * (count(*) over () - row_number() over (order by p, prompt_kind) + 1)) as step from p)
select prompt_kind, "both", a_only, b_only, neither, round(p, 6) as p, round(max(step) over (order by p, prompt_kind rows unbounded preceding), 6) as holm from h""",
    "label_events": """with m as (select distinct row_id, source, kind from manifest)
select coalesce(source, 'none') as source, count(*) as n, count(*) filter (kind is null) as unknown, count(*) filter (kind = 'natural') as "natural",
  round(count(*) filter (kind = 'natural') / count(*), 6) as of_all, round(count(*) filter (kind = 'natural') / nullif(count(kind), 0), 6) as of_known from m group by 1""",
    "smoothing": """with r as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as n from events),
s as (select a.user_id, a.event_id, sum(0.1::double * b.value * pow(0.9::double, a.n - b.n)) / (1 - pow(0.9::double, any_value(a.n))) as x from r a join r b on a.user_id = b.user_id and b.n <= a.n group by 1, 2)
select user_id, event_id, round(x, 6) as x from s""",
    "softmax_entropy": """with e as (select vec_id, unnest(embedding)::double as x from embeddings), m as (select vec_id, max(x) as m from embeddings, unnest(embedding) as u(x) group by vec_id),
s as (select e.vec_id, sum(exp(x - m)) as t, sum(exp(x - m) * (x - m)) as u from e join (select vec_id, max(x) as m from e group by vec_id) m using (vec_id) group by e.vec_id)
select vec_id, round(ln(t) - u / t, 6) as entropy from s""",
    "importance": f"""with {_LINES}, d as (select prompt, greatest(-20.0, least(20.0, ln(r1 + 0.05) - ln(r2 + 0.05))) as d from x),
g as (select prompt, avg(d) as m, avg(exp(d) - 1 - d) as k3, avg(least(exp(d), 2.0)) as token, avg(case when exp(d) <= 2 then exp(d) else 0.0 end) as masked from d group by prompt),
v as (select *, least(exp(m), 2.0) as w from g)
select count(*) as n, round(avg(k3), 6) as k3, round(avg(token), 6) as token, round(avg(masked), 6) as masked, round(avg(w), 6) as sequence, round(avg(case when exp(m) > 2 then 1.0 else 0.0 end), 6) as clipped,
  round(avg(w) ** 2 / avg(w * w), 6) as effective, round(avg((exp(m) - 1) ** 2), 6) as chi2 from v""",
    "off_policy": f"""with {_LINES}, d as (select prompt, avg(r1 - r2) as d from x group by prompt)
select d > 0.02 and round(r - m, 9) < 0 as masked, count(*) as n from w join d using (prompt) group by 1""",
    "chunk_metrics": """with g as (select l_returnflag, l_linestatus, count(*) as size, avg(l_discount) as v, min(l_tax) as a, max(l_tax) as b from lineitem group by 1, 2)
select round(sum(v * size) / sum(size), 6) as weighted, round(avg(v), 6) as unweighted, min(a) as low, max(b) as high from g""",
}
ORACLE["softmax_entropy"] = """with e as (select vec_id, unnest(embedding)::double as x from embeddings), m as (select vec_id, max(x) as m from e group by vec_id),
s as (select e.vec_id, sum(exp(x - m)) as t, sum(exp(x - m) * (x - m)) as u from e join m using (vec_id) group by e.vec_id)
select vec_id, round(ln(t) - u / t, 6) as entropy from s"""

QUERIES = {
    f.__name__: f
    for f in (
        adv_group, adv_leave_one_out, adv_batch_scaled, adv_whitened, adv_per_reward, adv_per_request, reward_groups, reward_columns, varied_groups, best_of_n, minmax, rotated,
        early_stop, pair_scores, pair_correlation, pair_losses, pair_hard_losses, batch_margin, ranking, marked_groups, wilson_rates, paired_tests, label_events, smoothing, softmax_entropy,
        importance, perplexities, off_policy, chunk_metrics,
    )
}
