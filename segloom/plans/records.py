"""Queries on record streams: scans, resuming, filters, joins, guards, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions import text as tx
from segloom.operators import groups as gr
from segloom.operators import records as rc
from segloom.operators import sampling as sm
from segloom.session import table


def six(x):
    return F.round(x, 6)


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "outputs").dropDuplicates(["output_id"])


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "manifest").dropDuplicates(["row_id"])


_O = "o as (select distinct on (output_id) * from outputs)"
_M = "m as (select distinct on (row_id) * from manifest)"


def rec_tolerant_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Answers read as lines of JSON: blank, objects, and what is skipped, per model."""
    rows = _outputs(spark, folder).select("model", F.trim(F.coalesce("raw_output", F.lit("")), F.lit(" \n\r\t")).alias("v"))
    kind = F.when(F.col("v") == "", "blank").when(tx.is_object(F.col("v")), "object").otherwise("skipped")
    return rows.groupBy("model", kind.alias("kind")).agg(F.count("*").alias("n"))


def rec_test_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation records: file stem as id, duration or 30, and whether the first answer is a JSON object."""
    rows = table(spark, folder, "test").dropDuplicates(["row_id"])
    first = F.get(F.filter("conversations", lambda t: t["from"] == "gpt"), 0)["value"]
    return rows.select("row_id", tx.stem(F.col("video")).alias("video_id"), F.coalesce(F.nullif("video_duration", F.lit(0.0)), F.lit(30.0)).alias("duration"), F.coalesce(tx.is_object(tx.json_object(first)), F.lit(False)).alias("parsed"))


def rec_last_nonempty(spark: SparkSession, folder: str) -> DataFrame:
    """The last answer of each model and case that isn't blank."""
    rows = _outputs(spark, folder).filter(F.trim(F.coalesce("raw_output", F.lit("")), F.lit(" \n\r\t")) != "")
    rows = rows.select("model", "case_id", "generated_at", "output_id", "finish_reason", F.md5("raw_output").alias("digest"))
    return gr.last_per(rows, ["model", "case_id"], ["generated_at", "output_id"]).select("model", "case_id", "output_id", "finish_reason", "digest")


def rec_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    return rc.repeated(_outputs(spark, folder), ["model", "case_id"])


def rec_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of each record: number, characters, digest of the joined texts."""
    g = F.filter("conversations", lambda t: t["from"] == "gpt")
    v = F.transform(g, lambda t: F.coalesce(t["value"], F.lit("")))
    rows = table(spark, folder, "train").dropDuplicates(["row_id"]).filter(F.size(g) > 0)
    return rows.select("row_id", F.size(g).alias("n"), F.aggregate(v, F.lit(0), lambda a, x: a + F.char_length(x)).alias("characters"), F.md5(F.array_join(v, "|")).alias("digest"))


def rec_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Records of two kinds in one frame, absent columns null; rows and nulls per kind."""
    a = table(spark, folder, "test").dropDuplicates(["row_id"]).select(F.lit("test").alias("kind"), "row_id", "video", "video_duration")
    b = _manifest(spark, folder).select(F.lit("manifest").alias("kind"), "row_id", "video_id", "video_duration")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.count("video").alias("video"), F.count("video_id").alias("video_id"), F.count("video_duration").alias("video_duration"))


def rec_digests(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 and MD5 of texts."""
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


def rec_sorted_set(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct annotators of a clip, sorted and joined by commas."""
    rows = table(spark, folder, "segments").filter("annotator is not null").select("video_id", "annotator").distinct()
    return rows.groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list("annotator")), ",").alias("annotators"))


def res_remaining(spark: SparkSession, folder: str) -> DataFrame:
    """Clips left to do, if every answer counts as done, and if only those without an error do."""
    m, o = _manifest(spark, folder).select("video_id"), _outputs(spark, folder)
    every = rc.remaining(m, o, "video_id").agg(F.count("*").alias("n")).select(F.lit("every").alias("done"), "n")
    sound = rc.remaining(m, o, "video_id", F.col("finish_reason") == "stop").agg(F.count("*").alias("n")).select(F.lit("sound").alias("done"), "n")
    return every.unionByName(sound)


def res_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Answers whose key repeats, and answers of clips that the manifest doesn't have."""
    o, m = _outputs(spark, folder), _manifest(spark, folder).select("video_id").distinct()
    a = rc.repeated(o, ["model", "case_id"]).agg(F.count("*").alias("n")).select(F.lit("repeated").alias("guard"), "n")
    b = o.join(m, "video_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown").alias("guard"), "n")
    return a.unionByName(b)


def res_cached(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts by digest: those of at least three answers are taken from the cache, the others generated."""
    o = _outputs(spark, folder).select(F.md5(F.concat_ws("|", "model", "prompt")).alias("key"))
    cache = o.groupBy("key").agg(F.count("*").alias("choices"))
    return o.join(cache, "key").groupBy((F.col("choices") >= 3).alias("cached")).agg(F.count("*").alias("n"))


def flt_drop_reason(spark: SparkSession, folder: str) -> DataFrame:
    """The first reason to leave a clip out: no path, no duration, too short, static."""
    d, p, m = F.col("video_duration"), F.col("video_path"), F.col("static_metrics")
    reason = rc.first_reason(
        [
            (p.isNull() | (p == ""), "missing_video"), (d.isNull() | (d == 0), "missing_duration"), (d < 1, "duration_below_minimum"), (m.isNull(), "static_check_failed"),
            ((m["avg_phash_hamming"] <= 4) & (m["avg_optical_flow"] <= 0.25), "static"),
        ]
    )
    return _manifest(spark, folder).groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).withColumn("keep", F.col("reason") == "")


def flt_keep_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Kept clips (null counts as kept) at the places 100 to 199 of the order by id."""
    rows = sm.placed(_manifest(spark, folder).filter(F.coalesce("keep", F.lit(True))).select("row_id", "video_id"), ["row_id"])
    return rows.filter(F.col("rn").between(100, 199)).select("row_id", "video_id", F.col("rn").alias("place"))


def flt_error_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with an error go past the stage; others get its result or the error of a missing precondition."""
    o = _outputs(spark, folder).withColumn("error", F.when(F.col("finish_reason") == "error", "model_error"))
    passed, work = o.filter("error is not null"), o.filter("error is null")
    work = work.withColumn("error", F.when(F.trim(F.coalesce("raw_output", F.lit("")), F.lit(" \n\r\t")) == "", "missing_answer"))
    return work.unionByName(passed).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


def flt_finite(spark: SparkSession, folder: str) -> DataFrame:
    """Segments whose times are finite numbers and whose reason has 1 to 200 characters."""
    rows = table(spark, folder, "segments").dropDuplicates(["segment_id"])
    number = lambda c: F.coalesce(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    bounded = F.coalesce(F.char_length(F.trim("reason")).between(1, 200), F.lit(False))
    return rows.groupBy(number("start_time").alias("start"), number("end_time").alias("end"), bounded.alias("reason")).agg(F.count("*").alias("n"))


def flt_overlap_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that both splits have."""
    a = table(spark, folder, "train").select("video").distinct()
    return table(spark, folder, "test").select("video").distinct().join(a, "video", "left_semi")


def flt_media(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of media by file ending."""
    kind = F.coalesce(tx.media_kind(F.col("video")), F.lit("other"))
    return table(spark, folder, "train").dropDuplicates(["row_id"]).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def flt_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Segments whose event mentions one of three words."""
    rows = table(spark, folder, "segments").filter(F.lower("event").rlike("birthday|bicycle|kitchen"))
    return rows.select("segment_id").distinct()


def flt_media_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Records by number of video marks in the questions and in the answers."""
    marks = lambda role: F.aggregate(F.filter("conversations", lambda t: t["from"] == role), F.lit(0), lambda a, t: a + F.coalesce(F.regexp_count(t["value"], F.lit("<video>")), F.lit(0)))
    rows = table(spark, folder, "train").dropDuplicates(["row_id"]).filter("conversations is not null")
    return rows.groupBy(marks("human").alias("questions"), marks("gpt").alias("answers")).agg(F.count("*").alias("n"))


def join_committee(spark: SparkSession, folder: str) -> DataFrame:
    """Two judges per line of an order, either may be missing: mean of those present, lines that fail, and the order's mean."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    base = gr.last_per(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity", "l_discount"])
    a = base.filter("l_partkey % 3 <> 0").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("qa"))
    b = base.filter("l_partkey % 5 <> 0").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 50).alias("qb"))
    rows = base.select("l_orderkey", "l_linenumber").join(a, ["l_orderkey", "l_linenumber"], "left").join(b, ["l_orderkey", "l_linenumber"], "left")
    score = rc.mean_of_present([(F.col("qa").isNotNull(), F.col("qa")), (F.col("qb").isNotNull(), F.col("qb"))])
    rows = rows.withColumn("score", score).withColumn("passed", F.round("score", 9) >= 2.5)
    return rows.groupBy("l_orderkey").agg(
        six(F.avg("score")).alias("score"), F.bool_and("passed").alias("passed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("l_linenumber")))).cast("array<string>"), ",").alias("failed"),
    )


def join_judge_average(spark: SparkSession, folder: str) -> DataFrame:
    """A given average or the mean of two dimensions per line; mean of the order and whether all reach 20."""
    li = table(spark, folder, "lineitem").select("l_orderkey", rc.given_or_mean(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(0.0), [F.col("l_quantity"), F.col("l_discount") * 100]).alias("q"))
    return li.groupBy("l_orderkey").agg(six(F.coalesce(F.avg("q"), F.lit(0.0))).alias("average"), F.coalesce(F.bool_and(F.round("q", 9) >= 20), F.lit(True)).alias("passed"))


def join_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with customer, nation and region by lookup of small tables; totals per region and segment."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")  # fixed tables of 25 and 5 rows
    rows = o.join(c, o.o_custkey == c.c_custkey, "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.groupBy(F.coalesce("r_name", F.lit("none")).alias("region"), F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def join_within_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different suppliers within an order, by supplier; an order has seven lines at most."""
    a = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    rows = a.withColumnRenamed("l_suppkey", "x").join(a.withColumnRenamed("l_suppkey", "y"), "l_orderkey").filter("x < y")
    return rows.groupBy("x").agg(F.count("*").alias("pairs"))


def join_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with lines, without lines, and lines without an order."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return n(o.join(li, "k", "left_semi"), "both").unionByName(n(o.join(li, "k", "left_anti"), "left")).unionByName(n(li.join(o, "k", "left_anti"), "right"))


def join_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to the original and to the still clip: how often the length class stays, per model."""
    o = _outputs(spark, folder).filter("raw_output is not null").groupBy("model", "prompt_kind", "video_id", "condition_name").agg(F.max(F.floor(F.char_length("raw_output") / 500)).alias("size"))
    side = lambda c, name: o.filter(F.col("condition_name") == c).select("model", "prompt_kind", "video_id", F.col("size").alias(name))
    rows = side("original", "a").join(side("static_middle", "b"), ["model", "prompt_kind", "video_id"])
    return rows.groupBy("model").agg(F.count("*").alias("pairs"), six(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("kept"))


def join_prompt_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts numbered by first appearance."""
    by = _outputs(spark, folder).filter("prompt is not null").groupBy("prompt").agg(F.min("output_id").alias("first"), F.count("*").alias("n"))
    return sm.placed(by, ["first"]).select(F.md5("prompt").alias("prompt"), "n", F.col("rn").alias("code"))


def join_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with the split and kind of their clip, and whether the run ended by length."""
    m = _manifest(spark, folder).groupBy("video_id").agg(F.min(F.coalesce("split_name", F.lit("none"))).alias("split"))
    rows = _outputs(spark, folder).join(m, "video_id").withColumn("cut", F.coalesce(F.col("finish_reason") == "length", F.lit(False)))
    return rows.groupBy("split", "cut").agg(F.count("*").alias("n"), F.sum(F.coalesce("generated_tokens", F.lit(0))).cast("bigint").alias("tokens"))


def join_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each type of a user."""
    ev = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return gr.first_per(ev, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def agg_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    o = _outputs(spark, folder)
    return o.groupBy("model", F.coalesce("finish_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def agg_contingency(spark: SparkSession, folder: str) -> DataFrame:
    """Two flags of the manifest against each other, with margins by grouping sets."""
    m = _manifest(spark, folder).select(F.coalesce("keep", F.lit(True)).alias("kept"), (F.col("video_duration") > 20).alias("long")).filter("long is not null")
    return m.cube("kept", "long").agg(F.count("*").alias("n"))


def agg_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct clips per annotator and whether a segment has an event."""
    s = table(spark, folder, "segments").filter("annotator is not null")
    return s.groupBy("annotator", F.col("event").isNotNull().alias("event")).agg(F.countDistinct("video_id").alias("clips"), F.countDistinct("segment_id").alias("segments"))


def agg_disagreement(spark: SparkSession, folder: str) -> DataFrame:
    """Clips to which more than one source is given across the two tables."""
    a = table(spark, folder, "train").select(tx.stem(F.col("video")).alias("video_id"), "source")
    b = _manifest(spark, folder).select("video_id", "source")
    u = a.unionByName(b).filter("source is not null").distinct()
    return u.groupBy("video_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources")).filter("n > 1")


def agg_first_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """The first answer to each prompt and model."""
    o = _outputs(spark, folder).filter("prompt is not null").select("model", "prompt", "output_id", "condition_name")
    return gr.first_per(o, ["model", "prompt"], ["output_id"]).select("model", "output_id", "condition_name")


def agg_weakest(spark: SparkSession, folder: str) -> DataFrame:
    """Per order the lowest of three averages, all of them on a tie."""
    by = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(six(F.avg("l_discount")).alias("discount"), six(F.avg("l_tax")).alias("tax"), six(F.avg("l_quantity") / 500).alias("quantity"))
    low = F.least("discount", "tax", "quantity")
    names = F.filter(F.array(*(F.when(F.col(c) == low, F.lit(c)) for c in ("discount", "tax", "quantity"))), lambda x: x.isNotNull())
    return by.select("l_orderkey", F.array_join(names, ",").alias("weakest"), low.alias("score"))


def agg_macro_micro(spark: SparkSession, folder: str) -> DataFrame:
    """Mean reason length over segments, and over the means of clips."""
    s = table(spark, folder, "segments").dropDuplicates(["segment_id"]).filter("reason is not null").select("video_id", F.char_length("reason").alias("n"))
    by = s.groupBy("video_id").agg(F.avg("n").alias("m"), F.sum("n").alias("s"), F.count("*").alias("c"))
    return by.agg(six(F.sum("s") / F.sum("c")).alias("segment_mean"), six(F.avg("m")).alias("clip_mean"))


def agg_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Answers and tokens per hour of each model, repeated deliveries counted once."""
    by = _outputs(spark, folder).groupBy("model").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("generated_tokens", F.lit(0))).cast("bigint").alias("tokens"),
        ((F.unix_micros(F.max("generated_at").cast("timestamp")) - F.unix_micros(F.min("generated_at").cast("timestamp"))) / 3.6e9).alias("hours"),
    )
    return by.select("model", "n", "tokens", six(F.col("n") / F.col("hours")).alias("answers_per_hour"), six(F.col("tokens") / F.col("hours")).alias("tokens_per_hour"))


def agg_exact_match(spark: SparkSession, folder: str) -> DataFrame:
    """How often the flag and the status of neighbouring lines of an order are equal; by line and by whole order."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_returnflag") == F.when(F.col("l_linestatus") == "O", "N").otherwise("R")).cast("int").alias("hit"))
    by = rows.groupBy("l_orderkey").agg(F.sum("hit").alias("h"), F.count("*").alias("n"))
    return by.agg(six(F.sum("h") / F.sum("n")).alias("by_line"), six(F.avg((F.col("h") == F.col("n")).cast("double"))).alias("by_order"))


def agg_class_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of kept and dropped clips, at least 1 each, and the bounds of the balancing weights."""
    k = _manifest(spark, folder).agg(F.greatest(F.count_if(F.coalesce("keep", F.lit(True))), F.lit(1)).alias("kept"), F.greatest(F.count_if(~F.coalesce("keep", F.lit(True))), F.lit(1)).alias("dropped"))
    return k.select("kept", "dropped", F.round(F.col("dropped") / F.col("kept"), 2).alias("low"), F.round(F.col("dropped") * 1.33 / F.col("kept"), 2).alias("high"))


def agg_best_marked(spark: SparkSession, folder: str) -> DataFrame:
    """Models by mean answer length and share of stops, the best of each column marked."""
    by = _outputs(spark, folder).groupBy("model").agg(six(F.avg(F.char_length("raw_output"))).alias("length"), six(F.avg((F.coalesce("finish_reason", F.lit("")) == "stop").cast("double"))).alias("stopped"))
    best = by.agg(F.min("length").alias("a"), F.max("stopped").alias("b"))
    return by.join(F.broadcast(best)).select("model", "length", "stopped", (F.abs(F.col("length") - F.col("a")) < 1e-9).alias("shortest"), (F.abs(F.col("stopped") - F.col("b")) < 1e-9).alias("steadiest"))


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Clips of two tables: union, intersection, differences, and all with repeats."""
    a = table(spark, folder, "outputs").select("video_id")
    b = table(spark, folder, "documents").select("video_id")
    parts = {"union": a.union(b).distinct(), "both": a.intersect(b), "outputs_only": a.subtract(b), "documents_only": b.subtract(a), "all": a.unionAll(b)}
    n = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, df in parts.items()]
    out = n[0]
    for x in n[1:]:
        out = out.unionByName(x)
    return out


_BLANK = "trim(coalesce(raw_output, ''), ' ' || chr(10) || chr(13) || chr(9))"
ORACLE = {
    "rec_tolerant_lines": f"""with {_O}, v as (select model, {_BLANK} as v from o)
select model, case when v = '' then 'blank' when json_valid(v) and json_type(case when json_valid(v) then v end) = 'OBJECT' then 'object' else 'skipped' end as kind, count(*) as n from v group by 1, 2""",
    "rec_test_scan": """with t as (select distinct row_id, video, video_duration, trim(list_filter(conversations, lambda t: t."from" = 'gpt')[1].value, ' ' || chr(10) || chr(13) || chr(9)) as v from test),
f as (select *, case when starts_with(v, '```') then regexp_replace(regexp_replace(v, '^```[a-zA-Z]*\\s*', ''), '\\s*```$', '') else v end as w from t), b as (select *, regexp_extract(w, '(?s)\\{.*\\}', 0) as c from f),
k as (select *, case when json_valid(w) then json_type(w::json) end as kw, case when json_valid(c) then json_type(c::json) end as kc from b)
select row_id, regexp_extract(replace(video, chr(92), '/'), '([^/]+?)(\\.[^./]*)?$', 1) as video_id, coalesce(nullif(video_duration, 0), 30.0) as duration,
  coalesce(case when kw is not null then kw = 'OBJECT' else kc = 'OBJECT' end, false) as parsed from k""",
    "rec_last_nonempty": f"""with {_O}, k as (select *, row_number() over (partition by model, case_id order by generated_at desc, output_id desc) as k from o where {_BLANK} <> '')
select model, case_id, output_id, finish_reason, md5(raw_output) as digest from k where k = 1""",
    "rec_repeated_keys": f"with {_O} select model, case_id, count(*) as n from o group by 1, 2 having count(*) > 1",
    "rec_replies": """with g as (select distinct row_id, list_transform(list_filter(conversations, lambda t: t."from" = 'gpt'), lambda t: coalesce(t.value, '')) as v from train)
select row_id, cast(len(v) as integer) as n, cast(list_sum(list_transform(v, lambda x: length(x))) as integer) as characters, md5(array_to_string(v, '|')) as digest from g where len(v) > 0""",
    "rec_backfill": f"""with {_M}, t as (select distinct row_id, video, video_duration from test)
select 'test' as kind, count(*) as n, count(video) as video, cast(0 as bigint) as video_id, count(video_duration) as video_duration from t
union all select 'manifest', count(*), 0, count(video_id), count(video_duration) from m""",
    "rec_digests": "select doc_id, sha256(text) as sha256, md5(text) as md5 from documents",
    "rec_sorted_set": "select video_id, string_agg(annotator, ',' order by annotator) as annotators from (select distinct video_id, annotator from segments where annotator is not null) group by 1",
    "res_remaining": f"""with {_O}, {_M} select 'every' as done, count(*) as n from m where video_id is null or video_id not in (select video_id from o where video_id is not null)
union all select 'sound', count(*) from m where video_id is null or video_id not in (select video_id from o where video_id is not null and finish_reason = 'stop')""",
    "res_guards": f"""with {_O}, {_M} select 'repeated' as guard, count(*) as n from (select 1 from o group by model, case_id having count(*) > 1)
union all select 'unknown', count(*) from o where not exists (select 1 from m where m.video_id = o.video_id)""",
    "res_cached": f"""with {_O}, k as (select md5(concat_ws('|', model, prompt)) as key from o), c as (select key, count(*) as n from k group by 1)
select c.n >= 3 as cached, count(*) as n from k join c using (key) group by 1""",
    "flt_drop_reason": f"""with {_M}, r as (select case when video_path is null or video_path = '' then 'missing_video' when video_duration is null or video_duration = 0 then 'missing_duration'
  when video_duration < 1 then 'duration_below_minimum' when static_metrics is null then 'static_check_failed'
  when static_metrics.avg_phash_hamming <= 4 and static_metrics.avg_optical_flow <= 0.25 then 'static' else '' end as reason from m)
select reason, count(*) as n, reason = '' as keep from r group by 1""",
    "flt_keep_slice": f"with {_M}, p as (select row_id, video_id, row_number() over (order by row_id) - 1 as place from m where coalesce(keep, true)) select * from p where place between 100 and 199",
    "flt_error_pass": f"with {_O} select case when finish_reason = 'error' then 'model_error' when {_BLANK} = '' then 'missing_answer' else 'none' end as error, count(*) as n from o group by 1",
    "flt_finite": """with s as (select distinct on (segment_id) * from segments)
select coalesce(isfinite(start_time), false) as start, coalesce(isfinite(end_time), false) as "end", coalesce(length(trim(reason, ' ')) between 1 and 200, false) as reason, count(*) as n from s group by 1, 2, 3""",
    "flt_overlap_guard": "select distinct video from test where video in (select video from train)",
    "flt_media": """with t as (select distinct row_id, lower(regexp_extract(video, '\\.([A-Za-z0-9]+)$', 1)) as e from train)
select case when e in ('jpg', 'jpeg', 'png', 'gif', 'webp', 'bmp') then 'image' when e in ('mp4', 'mkv', 'mov', 'avi', 'mpeg', 'webm') then 'video' when e in ('mp3', 'wav', 'flac', 'ogg', 'm4a') then 'audio' else 'other' end as kind, count(*) as n from t group by 1""",
    "flt_keywords": "select distinct segment_id from segments where regexp_matches(lower(event), 'birthday|bicycle|kitchen')",
    "flt_media_marks": """with t as (select distinct row_id, conversations as c from train where conversations is not null),
m as (select cast(coalesce(list_sum(list_transform(list_filter(c, lambda t: t."from" = 'human'), lambda t: coalesce(len(regexp_extract_all(t.value, '<video>')), 0))), 0) as integer) as questions,
  cast(coalesce(list_sum(list_transform(list_filter(c, lambda t: t."from" = 'gpt'), lambda t: coalesce(len(regexp_extract_all(t.value, '<video>')), 0))), 0) as integer) as answers from t)
select questions, answers, count(*) as n from m group by 1, 2""",
    "join_committee": """with b as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_quantity desc, l_discount desc) as k from lineitem),
s as (select l_orderkey, l_linenumber, coalesce((case when l_partkey % 3 <> 0 then l_quantity / 10 else 0 end + case when l_partkey % 5 <> 0 then l_discount * 50 else 0 end)
  / nullif(case when l_partkey % 3 <> 0 then 1 else 0 end + case when l_partkey % 5 <> 0 then 1 else 0 end, 0), 0) as score from b where k = 1)
select l_orderkey, round(avg(score), 6) as score, bool_and(round(score, 9) >= 2.5) as passed, coalesce(string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber) filter (round(score, 9) < 2.5), '') as failed from s group by 1""",
    "join_judge_average": """with q as (select l_orderkey, coalesce(nullif(case when l_linenumber % 2 = 0 then l_quantity else 0 end, 0), (l_quantity + l_discount * 100) / 2) as q from lineitem)
select l_orderkey, round(avg(q), 6) as average, bool_and(round(q, 9) >= 20) as passed from q group by 1""",
    "join_lookup": """select coalesce(r_name, 'none') as region, coalesce(c_mktsegment, 'none') as segment, count(*) as n, round(sum(o_totalprice), 2) as total
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by 1, 2""",
    "join_within_pairs": "with a as (select distinct l_orderkey, l_suppkey as s from lineitem) select a.s as x, count(*) as pairs from a join a b on a.l_orderkey = b.l_orderkey and a.s < b.s group by 1",
    "join_guards": """with o as (select distinct o_orderkey as k from orders), l as (select distinct l_orderkey as k from lineitem)
select 'both' as side, count(*) as n from o where k in (select k from l) union all select 'left', count(*) from o where k not in (select k from l) union all select 'right', count(*) from l where k not in (select k from o)""",
    "join_conditions": f"""with {_O}, s as (select model, prompt_kind, video_id, condition_name, max(length(raw_output) // 500) as size from o where raw_output is not null group by 1, 2, 3, 4)
select a.model, count(*) as pairs, round(avg(case when a.size = b.size then 1.0 else 0.0 end), 6) as kept from s a join s b on a.condition_name = 'original' and b.condition_name = 'static_middle'
  and a.model = b.model and a.prompt_kind = b.prompt_kind and a.video_id = b.video_id group by 1""",
    "join_prompt_codes": f"with {_O}, p as (select prompt, min(output_id) as f, count(*) as n from o where prompt is not null group by 1) select md5(prompt) as prompt, n, row_number() over (order by f) - 1 as code from p",
    "join_requests": f"""with {_O}, v as (select video_id, min(coalesce(split_name, 'none')) as split from manifest group by 1)
select split, coalesce(finish_reason = 'length', false) as cut, count(*) as n, cast(sum(coalesce(generated_tokens, 0)) as bigint) as tokens from o join v using (video_id) group by 1, 2""",
    "join_first_seen": "with k as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) select user_id, event_type, event_id, value from k where k = 1",
    "agg_frequencies": f"with {_O} select model, coalesce(finish_reason, 'none') as reason, count(*) as n from o group by 1, 2",
    "agg_contingency": f"""with {_M}, f as (select coalesce(keep, true) as kept, video_duration > 20 as "long" from m where video_duration is not null) select kept, "long", count(*) as n from f group by cube (kept, "long")""",
    "agg_claims": "select annotator, event is not null as event, count(distinct video_id) as clips, count(distinct segment_id) as segments from segments where annotator is not null group by 1, 2",
    "agg_disagreement": f"""with {_M}, u as (select regexp_extract(replace(video, chr(92), '/'), '([^/]+?)(\\.[^./]*)?$', 1) as video_id, source from train where source is not null union select video_id, source from m where source is not null)
select video_id, count(*) as n, string_agg(source, ',' order by source) as sources from u where video_id is not null group by 1 having count(*) > 1""",
    "agg_first_prompt": f"with {_O}, k as (select *, row_number() over (partition by model, prompt order by output_id) as k from o where prompt is not null) select model, output_id, condition_name from k where k = 1",
    "agg_weakest": """with g as (select l_orderkey, round(avg(l_discount), 6) as discount, round(avg(l_tax), 6) as tax, round(avg(l_quantity) / 500, 6) as quantity from lineitem group by 1), l as (select *, least(discount, tax, quantity) as score from g)
select l_orderkey, array_to_string(list_filter([case when discount = score then 'discount' end, case when tax = score then 'tax' end, case when quantity = score then 'quantity' end], lambda x: x is not null), ',') as weakest, score from l""",
    "agg_macro_micro": """with s as (select distinct segment_id, video_id, length(reason) as n from segments where reason is not null), v as (select video_id, avg(n) as m, sum(n) as s, count(*) as c from s group by 1)
select round(sum(s) / sum(c), 6) as segment_mean, round(avg(m), 6) as clip_mean from v""",
    "agg_throughput": f"""with {_O}, g as (select model, count(*) as n, cast(sum(coalesce(generated_tokens, 0)) as bigint) as tokens, (epoch_us(max(generated_at)) - epoch_us(min(generated_at))) / 3.6e9 as hours from o group by 1)
select model, n, tokens, round(n / hours, 6) as answers_per_hour, round(tokens / hours, 6) as tokens_per_hour from g""",
    "agg_exact_match": """with h as (select l_orderkey, case when l_returnflag = case when l_linestatus = 'O' then 'N' else 'R' end then 1 else 0 end as h from lineitem), g as (select l_orderkey, sum(h) as h, count(*) as n from h group by 1)
select round(sum(h) / sum(n), 6) as by_line, round(avg(case when h = n then 1.0 else 0.0 end), 6) as by_order from g""",
    "agg_class_balance": f"""with {_M}, k as (select greatest(count(*) filter (coalesce(keep, true)), 1) as kept, greatest(count(*) filter (not coalesce(keep, true)), 1) as dropped from m)
select kept, dropped, round(dropped / kept, 2) as low, round(dropped * 1.33::double / kept, 2) as high from k""",
    "agg_best_marked": f"""with {_O}, g as (select model, round(avg(length(raw_output)), 6) as length, round(avg(case when coalesce(finish_reason, '') = 'stop' then 1.0 else 0.0 end), 6) as stopped from o group by 1)
select model, length, stopped, abs(length - min(length) over ()) < 1e-9 as shortest, abs(stopped - max(stopped) over ()) < 1e-9 as steadiest from g""",
    "set_operations": """with a as (select video_id from outputs), b as (select video_id from documents)
select 'union' as part, count(*) as n from (select * from a union select * from b) union all select 'both', count(*) from (select * from a intersect select * from b)
union all select 'outputs_only', count(*) from (select * from a except select * from b) union all select 'documents_only', count(*) from (select * from b except select * from a)
union all select 'all', count(*) from (select * from a union all select * from b)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        rec_tolerant_lines, rec_test_scan, rec_last_nonempty, rec_repeated_keys, rec_replies, rec_backfill, rec_digests, rec_sorted_set, res_remaining, res_guards, res_cached,
        flt_drop_reason, flt_keep_slice, flt_error_pass, flt_finite, flt_overlap_guard, flt_media, flt_keywords, flt_media_marks, join_committee, join_judge_average, join_lookup,
        join_within_pairs, join_guards, join_conditions, join_prompt_codes, join_requests, join_first_seen, agg_frequencies, agg_contingency, agg_claims, agg_disagreement,
        agg_first_prompt, agg_weakest, agg_macro_micro, agg_throughput, agg_exact_match, agg_class_balance, agg_best_marked, set_operations,
    )
}
