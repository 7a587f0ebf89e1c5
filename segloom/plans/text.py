"""Queries of text, JSON, conversation and scoring functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions import intervals as iv
from segloom.functions import text as tx
from segloom.functions import tools as tl
from segloom.operators import chat
from segloom.operators.ordered import scan
from segloom.plans.base import PRED, SEG, gt, pred, seg
from segloom.session import table

STOP = ["the", "and", "for", "with", "that", "this", "from", "once", "which", "while"]


def six(x):
    return F.round(x, 6)


def txt_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each text, half its characters where it has none, and distinct words."""
    return table(spark, folder, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"), F.size(tx.token_set(F.col("text"))).alias("distinct_words"))


def txt_reason_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Per clip the mean of a length kernel over reasons, 0 for those that nearly repeat the one before."""
    rows = seg(spark, folder).select("entity", "s", "id", F.coalesce("reason", F.lit("")).alias("reason"))
    rows = scan(rows, "entity", ["s", "id"], lags=["reason"])
    near = F.coalesce(tx.jaccard(tx.token_set(F.col("reason")), tx.token_set(F.col("prev_reason"))) > 0.75, F.lit(False)) & (F.col("prev_reason") != "")
    score = F.when(F.col("reason") == "", 0.0).when(near, 0.0).otherwise(F.exp(-F.abs(tx.word_count(F.col("reason")) - 120) / 40))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), six(F.avg(score)).alias("score"))


def txt_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent terms of each text, by term on a tie."""
    rows = table(spark, folder, "documents").select("doc_id", F.explode(tx.terms(F.col("text"), STOP)).alias("term"))
    by = rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    return by.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


def txt_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Share of repeated word trigrams of each reason."""
    rows = table(spark, folder, "segments").filter("reason is not null").select("segment_id", "reason").dropDuplicates(["segment_id"])
    return rows.select("segment_id", six(tx.repetition(F.col("reason"))).alias("repetition"))


def txt_json_object(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON object of each answer: kind and digest of its text."""
    rows = table(spark, folder, "outputs").filter("raw_output is not null").dropDuplicates(["output_id"])
    return rows.select("output_id", F.md5(tx.json_object(F.col("raw_output"))).alias("digest"))


def txt_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags, boxes, reward numbers and actions in texts made of the events."""
    ev = table(spark, folder, "events")
    text = F.concat(F.lit("<think>"), F.col("props"), F.lit("</think>\n<answer> "), F.col("event_type"), F.lit(" </answer> \\boxed{"), F.col("user_id").cast("string"), F.lit("} Reward: 0."), (F.col("event_id") % 10).cast("string"))
    rows = ev.select("event_id", text.alias("t"), F.concat(F.lit("Action: a\nAction Input: x\nAction: "), F.col("event_type"), F.lit("\nAction Input: "), F.col("props")).alias("act"))
    a = tl.action(F.col("act"))
    return rows.select(
        "event_id", tx.tagged(F.col("t"), "answer").alias("answer"), tx.boxed(F.col("t")).alias("boxed"), tx.reward_number(F.col("t")).alias("reward"),
        F.col("t").rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>").alias("formatted"), a["name"].alias("action"), a["arguments"].alias("input"),
    )


def txt_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls written in four ways come out alike."""
    ev = table(spark, folder, "events")
    e, k = F.col("event_type"), F.get_json_object("props", "$.k")
    j = F.concat(F.lit('{"name": "'), e, F.lit('", "arguments": {"k": '), k, F.lit("}}"))
    rows = ev.select(
        "event_id",
        tl.tagged_json(F.concat(F.lit("I call <tool_call>\n"), j, F.lit("\n</tool_call> now"))).alias("tagged"),
        tl.bracketed_json(F.concat(F.lit("[TOOL_CALLS] ["), j, F.lit(", "), j, F.lit("]")), r"\[TOOL_CALLS\]").alias("bracketed"),
        tl.xml_parameters(F.concat(F.lit("<function="), e, F.lit("><parameter=k>"), k, F.lit("</parameter></function>"))).alias("xml"),
        tl.keyed_arguments(F.concat(F.lit("<tool_call>"), e, F.lit("\n<arg_key>k</arg_key><arg_value>"), k, F.lit("</arg_value></tool_call>"))).alias("keyed"),
    )
    return rows.select(
        "event_id", F.col("tagged")[0]["name"].alias("name"), F.get_json_object(F.col("tagged")[0]["arguments"], "$.k").alias("a"), F.size("bracketed").alias("calls"),
        F.get_json_object(F.col("xml")[0]["arguments"], "$.k").alias("b"), F.col("keyed")[0]["name"].alias("keyed"), F.get_json_object(F.col("keyed")[0]["arguments"], "$.k").alias("c"),
    )


def txt_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Stem, ending and folder of each path."""
    rows = table(spark, folder, "train").select("row_id", "video").distinct()
    return rows.select("row_id", tx.stem(F.col("video")).alias("stem"), F.regexp_extract("video", r"\.([^./]*)$", 1).alias("ending"), F.when(F.startswith("video", F.lit("/data/")), F.replace("video", F.lit("/data/"), F.lit("/mnt/"))).otherwise(F.col("video")).alias("moved"))


def txt_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document quotes the id of its clip, and its numbers in two notations."""
    rows = table(spark, folder, "documents").filter("video_id is not null")
    return rows.select("doc_id", F.contains("text", F.col("video_id")).alias("quoted"), F.format_string("%.1f", F.col("n_chars") / 7).alias("plain"), F.translate(F.format_string("%.1f", F.col("n_chars") / 7), ".", ",").alias("comma"))


def txt_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as parts between line ends, headings weighted 0 and list items one half."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "part")).filter("part <> ''")
    weight = F.when(F.startswith("part", F.lit("#")), 0.0).when(F.startswith("part", F.lit("- ")), 0.5).otherwise(1.0)
    return rows.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.char_length("part") * weight).alias("weighted"))


def num_kernels(spark: SparkSession, folder: str) -> DataFrame:
    """Clamps, kernels, roundings and schedules of the lines' numbers."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, folder, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n")).select(
        "l_quantity", "l_discount", "n", iv.clamp(q, F.lit(5.0), F.lit(40.0)).alias("clamped"), six(F.exp(-F.abs(q - 25) / 1.5)).alias("count_kernel"), six(F.exp(-F.abs(q * 10 - 120) / 40)).alias("length_kernel"),
        F.floor(q * 0.3 + 0.5).cast("bigint").alias("half_up"), six(0.5 + 0.5 * F.cos(F.lit(3.141592653589793) * q / 50)).alias("cosine"), F.least(F.lit(0.0), (40 - q) / 10).alias("overlong"),
        F.when(q < 10, six(q / 10)).when(q > 40, 0.1).otherwise(six(0.1 + 0.45 * (1 + F.cos(F.lit(3.141592653589793) * (q - 10) / 30)))).alias("schedule"), (F.floor(q / 28) * 28).cast("bigint").alias("floored"), (F.ceil(q / 28) * 28).cast("bigint").alias("ceiled"),
        six(F.coalesce(F.try_divide(d, q - 1), F.lit(0.0))).alias("safe"),
    )


def num_hamming(spark: SparkSession, folder: str) -> DataFrame:
    """Bits that differ between keys of neighbouring suppliers."""
    s = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") * 2654435761 % 4294967296).alias("h"))
    o = s.select((F.col("s_suppkey") + 1).alias("s_suppkey"), F.col("h").alias("g"))
    return s.join(o, "s_suppkey").select("s_suppkey", F.bit_count(F.col("h").bitwiseXOR(F.col("g"))).alias("bits"))


def num_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Corners within a frame of 640 by 360, brought to a thousandth of it."""
    ev = table(spark, folder, "events").filter("value is not null")
    x, y = F.col("value") % 640, F.col("value") * 7 % 360
    return ev.select("event_id", F.floor(x / 640 * 1000 + 0.5).cast("bigint").alias("x"), F.floor(y / 360 * 1000 + 0.5).cast("bigint").alias("y"))


def num_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Scores capped by a rule table: the lowest cap of an order's flags, one less from two returns on."""
    rules = spark.createDataFrame([("R", 2), ("A", 4), ("N", 5)], "flag string, cap int")  # three rows
    rows = table(spark, folder, "lineitem").join(F.broadcast(rules), F.col("l_returnflag") == F.col("flag"))
    by = rows.groupBy("l_orderkey").agg(F.min("cap").alias("cap"), F.count_if(F.col("flag") == "R").alias("r"))
    return by.select("l_orderkey", F.greatest(F.lit(0), F.col("cap") - F.when(F.col("r") >= 2, 1).otherwise(0)).alias("score"))


def num_soft_match(spark: SparkSession, folder: str) -> DataFrame:
    """Arguments against a reference: 1 for key and value, one half for the key alone."""
    ev = table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return ev.select("event_id", F.when(F.col("k").isNull(), 0.0).when(F.col("k").cast("int") == F.col("event_id") % 100, 1.0).otherwise(0.5).alias("score"))


def _chats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "train").dropDuplicates(["row_id"]).filter(F.size("conversations") > 0).select("row_id", "video_duration", chat.messages(F.col("conversations")).alias("m"))


_CHATS = """c0 as (select distinct row_id, video_duration, conversations from train where len(conversations) > 0),
c as (select row_id, video_duration, list_transform(conversations, lambda t: {'role': case t."from" when 'human' then 'user' when 'gpt' then 'assistant' else t."from" end, 'content': t.value}) as m from c0)"""


def prj_reshape(spark: SparkSession, folder: str) -> DataFrame:
    """System text apart, place of the last question, last reply popped: sizes and digests."""
    m = F.col("m")
    rest, reply = chat.popped(m)
    return _chats(spark, folder).select(
        "row_id", F.md5(chat.system_of(m)).alias("system"), F.size(chat.without_system(m)).alias("turns"), chat.last_of(m, "user").alias("last_question"), F.size(rest).alias("left"), F.md5(reply).alias("reply"),
        F.md5(chat.last_reply(m)).alias("last_reply"),
    )


def prj_flat(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as lines of role and content."""
    return _chats(spark, folder).select("row_id", F.md5(chat.flat(F.col("m"))).alias("digest"))


def prj_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with another answer to the last question."""
    r = chat.rejected(F.col("m"), F.lit("I do not know."))
    return _chats(spark, folder).select("row_id", F.size(r).alias("n"), F.md5(F.element_at(r, -1)["content"]).alias("last")).filter("n > 0")


def prj_exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """Query and response of each exchange."""
    rows = _chats(spark, folder).select("row_id", F.posexplode(chat.exchanges(chat.without_system(F.col("m")))).alias("k", "x"))
    return rows.select("row_id", "k", F.md5("x.query").alias("query"), F.md5("x.response").alias("response"))


def prj_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with one video tag at least."""
    m = chat.with_tags(F.col("m"), "<video>", F.lit(1))
    return _chats(spark, folder).select("row_id", F.md5(F.get(m, 0)["content"]).alias("first"))


def prj_thinking(spark: SparkSession, folder: str) -> DataFrame:
    """Replies before the last question without what they thought."""
    thought = F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.when(x["role"] == "assistant", F.concat(F.lit("<think>a</think>\n"), x["content"])).otherwise(x["content"]).alias("content")))
    m = chat.without_thinking(thought)
    return _chats(spark, folder).select("row_id", F.size(F.filter(m, lambda x: F.coalesce(F.startswith(x["content"], F.lit("<think>")), F.lit(False)))).alias("kept"), F.size("m").alias("n"))


def prj_rl_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows for reinforcement: an id by place, the question with the duration, the last answer as solution."""
    m = F.col("m")
    rows = _chats(spark, folder).filter("video_duration > 0").select("row_id", "video_duration", chat.last_reply(m).alias("solution"))
    return rows.select("row_id", F.format_string("row-%06d", "row_id").alias("id"), F.concat(F.lit("The video lasts "), F.format_string("%.1f", F.round("video_duration", 1)), F.lit("s.")).alias("question"), F.md5("solution").alias("solution"))


def prj_arms(spark: SparkSession, folder: str) -> DataFrame:
    """Two rows a record: the answer, and an auxiliary task that one arm has and the other repeats the answer for."""
    m = F.col("m")
    task = lambda name, x: F.struct(F.lit(name).alias("task"), F.md5(x).alias("target"))
    rows = _chats(spark, folder).withColumn("arm", F.explode(F.array(F.lit("graph"), F.lit("baseline"))))
    aux = F.when(F.col("arm") == "graph", chat.flat(m)).otherwise(chat.last_reply(m))
    return rows.select("row_id", "arm", F.explode(F.array(task("answer", chat.last_reply(m)), task("auxiliary", aux))).alias("x")).select("row_id", "arm", "x.task", "x.target")


def prj_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Clips expanded to cases by the conditions and prompts of their kind."""
    combos = [("natural", c, p) for c in ("original", "static_middle") for p in ("released", "factual")] + [("step", "original", "factual"), ("gray", "gray", "factual"), ("gray", "gray_to_white", "factual")]
    dim = spark.createDataFrame(combos, "kind string, condition string, prompt string")  # seven rows
    rows = table(spark, folder, "manifest").dropDuplicates(["row_id"]).join(F.broadcast(dim), "kind")
    return rows.select("row_id", F.concat_ws(":", "video_id", "condition", "prompt").alias("case_id"))


def prj_ranking_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as ranking rows: each positive (returned) line with 1, then each negative with 0, parts as text."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return li.select("l_orderkey", "label", F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" part "), F.col("l_partkey").cast("string")).alias("text")).groupBy("l_orderkey", "label").agg(F.count("*").alias("n"), F.min("text").alias("first"))


def prj_printable(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a thousand characters or more shortened for print."""
    t = F.col("text")
    short = F.when(F.char_length(t) >= 1000, F.concat(F.lit("<<<"), F.substring(t, 1, 20), F.lit("..."), F.char_length(t).cast("string"), F.lit(">>>"))).otherwise(t)
    return table(spark, folder, "documents").select("doc_id", F.md5(short).alias("digest"), F.char_length(short).alias("n"))


def prj_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """A base setting merged with those of each part size; the later one counts."""
    base = F.create_map(F.lit("lr"), F.lit("0.1"), F.lit("size"), F.lit("0"), F.lit("kind"), F.lit("base"))
    own = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    keys = F.map_keys(own)
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(keys, k)), own)
    rows = table(spark, folder, "part").select("p_size", "p_brand").distinct().select("p_size", "p_brand", merged.alias("s"))
    return rows.select("p_size", "p_brand", F.array_join(F.transform(F.array_sort(F.map_entries("s")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("settings"))


def prj_pairs_padded(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of an order as four candidates, padded, with an index clamped into them and the chosen one."""
    by = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_set("l_partkey")), 1, 4).alias("p"), F.max(F.col("l_quantity").cast("int") % 6).alias("i"))
    padded = F.concat("p", F.array_repeat(F.lit(-1).cast("bigint"), F.lit(4) - F.size("p")))
    at = F.least(F.greatest(F.col("i") - 1, F.lit(0)), F.lit(3))
    return by.select("l_orderkey", F.array_join(padded.cast("array<string>"), ",").alias("candidates"), F.get(padded, at).alias("chosen"))


def rwd_total(spark: SparkSession, folder: str) -> DataFrame:
    """Per clip a weighted sum of rewards: structure, number of segments, place IoU, label, reason length."""
    g = gt(spark, folder).select("entity", "idx", F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("label").alias("gl"))
    p = pred(spark, folder).select("entity", "idx", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("label").alias("pl"), "reason")
    n = lambda df, c: df.groupBy("entity").agg(F.count("*").alias(c))
    one = p.groupBy("entity").agg(F.bool_and(F.col("pe") - F.col("ps") >= 400).alias("long"), F.avg(F.exp(-F.abs(tx.word_count(F.coalesce("reason", F.lit(""))) - 120) / 40)).alias("reason"))
    two = g.join(p, ["entity", "idx"]).groupBy("entity").agg(F.sum(iv.iou(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge"))).alias("iou"), F.sum((F.coalesce((F.col("gl") == F.col("pl")) & (iv.iou(F.col("ps"), F.col("pe"), F.col("gs"), F.col("ge")) > 0.5), F.lit(False))).cast("double")).alias("hits"))
    rows = n(p, "np").join(n(g, "ng"), "entity").join(one, "entity").join(two, "entity", "left").fillna(0.0)
    total = 0.1 * F.when(F.col("long"), 0.7).otherwise(0.5) + 0.25 * F.exp(-F.abs(F.col("np") - F.col("ng")) / 1.5) + 0.25 * F.col("iou") / F.col("np") + 0.25 * F.col("hits") / F.col("np") + 0.15 * F.col("reason")
    return rows.select("entity", six(total).alias("reward"))


_W = "regexp_extract_all({}, '([A-Za-z0-9]+(?:''[A-Za-z0-9]+)?)')"
_WC = "case when len(" + _W + ") > 0 then len(" + _W + ") else length(trim({}, ' ')) // 2 end"


def _words(c: str) -> str:
    return _W.format(c)


def _count(c: str) -> str:
    return _WC.format(c, c, c)


_RX = "'[ \\n\\r\\t]+'"
ORACLE = {
    "txt_word_counts": f"select doc_id, cast({_count('text')} as integer) as words, cast(len(list_distinct({_words('lower(text)')})) as integer) as distinct_words from documents",
    "txt_reason_quality": f"""with {SEG}, r as (select entity, coalesce(reason, '') as r, lag(coalesce(reason, '')) over (partition by entity order by s, id) as p from seg),
t as (select *, list_distinct({_words('lower(r)')}) as a, list_distinct({_words('lower(p)')}) as b from r),
j as (select entity, r, p, case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end as j from t)
select entity, count(*) as n, round(avg(case when r = '' then 0.0 when p <> '' and j > 0.75 then 0.0 else exp(-abs({_count('r')} - 120) / 40.0) end), 6) as score from j group by 1""",
    "txt_terms": f"""with w as (select doc_id, trim(unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}')), '-') as term from documents),
c as (select doc_id, term, count(*) as n from w where length(term) >= 3 and term not in ({", ".join(f"'{x}'" for x in STOP)}) group by 1, 2), k as (select *, cast(row_number() over (partition by doc_id order by n desc, term) as integer) as rank from c)
select doc_id, term, n, rank from k where rank <= 3""",
    "txt_repetition": """with s as (select distinct segment_id, regexp_split_to_array(trim(lower(reason), ' '), '\\s+') as w from segments where reason is not null),
g as (select segment_id, len(w)::bigint - 2 as t, list_transform(range(1, greatest(len(w)::bigint - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as g from s)
select segment_id, round(case when t > 0 then 1 - len(list_distinct(g)) / t else 0.0 end, 6) as repetition from g""",
    "txt_json_object": """with o as (select distinct output_id, trim(raw_output, ' ' || chr(10) || chr(13) || chr(9)) as v from outputs where raw_output is not null),
f as (select output_id, case when starts_with(v, '```') then regexp_replace(regexp_replace(v, '^```[a-zA-Z]*\\s*', ''), '\\s*```$', '') else v end as w from o), b as (select *, regexp_extract(w, '(?s)\\{.*\\}', 0) as c from f)
select output_id, md5(case when json_valid(w) then case when json_type(w::json) = 'OBJECT' then w end when json_valid(c) then case when json_type(c::json) = 'OBJECT' then c end end) as digest from b""",
    "txt_tags": """select event_id, event_type as answer, cast(user_id as varchar) as boxed, cast('0.' || (event_id % 10) as double) as reward, true as formatted, event_type as action, props as input from events""",
    "txt_tool_calls": """select event_id, event_type as name, json_extract_string(props, '$.k') as a, cast(2 as integer) as calls, json_extract_string(props, '$.k') as b, event_type as keyed, json_extract_string(props, '$.k') as c from events""",
    "txt_paths": """select distinct row_id, regexp_extract(replace(video, chr(92), '/'), '([^/]+?)(\\.[^./]*)?$', 1) as stem, regexp_extract(video, '\\.([^./]*)$', 1) as ending,
  case when starts_with(video, '/data/') then replace(video, '/data/', '/mnt/') else video end as moved from train""",
    "txt_quotes": "select doc_id, contains(text, video_id) as quoted, printf('%.1f', n_chars / 7) as plain, replace(printf('%.1f', n_chars / 7), '.', ',') as comma from documents where video_id is not null",
    "txt_weights": """with p as (select doc_id, unnest(string_split(text, chr(10))) as p from documents)
select doc_id, count(*) as parts, sum(length(p) * case when starts_with(p, '#') then 0.0::double when starts_with(p, '- ') then 0.5::double else 1.0::double end) as weighted from p where p <> '' group by 1""",
    "num_kernels": """with g as (select l_quantity, l_discount, count(*) as n from lineitem group by 1, 2)
select l_quantity, l_discount, n, least(greatest(l_quantity, 5.0::double), 40.0::double) as clamped, round(exp(-abs(l_quantity - 25) / 1.5), 6) as count_kernel, round(exp(-abs(l_quantity * 10 - 120) / 40), 6) as length_kernel,
  cast(floor(l_quantity * 0.3::double + 0.5::double) as bigint) as half_up, round(0.5 + 0.5 * cos(3.141592653589793::double * l_quantity / 50), 6) as cosine, least(0.0::double, (40 - l_quantity) / 10) as overlong,
  case when l_quantity < 10 then round(l_quantity / 10, 6) when l_quantity > 40 then 0.1::double else round(0.1 + 0.45 * (1 + cos(3.141592653589793::double * (l_quantity - 10) / 30)), 6) end as schedule,
  cast(floor(l_quantity / 28) * 28 as bigint) as floored, cast(ceil(l_quantity / 28) * 28 as bigint) as ceiled, round(coalesce(l_discount / nullif(l_quantity - 1, 0), 0.0), 6) as safe from g""",
    "num_hamming": """with s as (select s_suppkey, cast(s_suppkey as hugeint) * 2654435761 % 4294967296 as h from supplier)
select a.s_suppkey, cast(bit_count(xor(cast(a.h as bigint), cast(b.h as bigint))) as integer) as bits from s a join s b on a.s_suppkey = b.s_suppkey + 1""",
    "num_boxes": "select event_id, cast(floor(value % 640 / 640 * 1000 + 0.5) as bigint) as x, cast(floor(value * 7 % 360 / 360 * 1000 + 0.5) as bigint) as y from events where value is not null",
    "num_caps": """with g as (select l_orderkey, min(case l_returnflag when 'R' then 2 when 'A' then 4 else 5 end) as cap, count(*) filter (l_returnflag = 'R') as r from lineitem where l_returnflag in ('R', 'A', 'N') group by 1)
select l_orderkey, cast(greatest(0, cap - case when r >= 2 then 1 else 0 end) as integer) as score from g""",
    "num_soft_match": "select event_id, case when json_extract_string(props, '$.k') is null then 0.0::double when cast(json_extract_string(props, '$.k') as integer) = event_id % 100 then 1.0::double else 0.5::double end as score from events",
    "prj_reshape": f"""with {_CHATS}, x as (select row_id, m, m[1].role = 'system' as sys, len(m)::bigint as n, list_max(list_transform(range(1, len(m)::bigint + 1), lambda i: case when m[i].role = 'user' then i - 1 else -1 end)) as lu,
  list_max(list_transform(range(1, len(m)::bigint + 1), lambda i: case when m[i].role = 'assistant' then i else -1 end)) as la from c)
select row_id, md5(case when sys then m[1].content end) as system, cast(case when sys then n - 1 else n end as integer) as turns, cast(lu as integer) as last_question, cast(case when m[n].role = 'assistant' then n - 1 else n end as integer) as "left",
  md5(case when m[n].role = 'assistant' then m[n].content end) as reply, md5(case when la > 0 then m[la].content end) as last_reply from x""",
    "prj_flat": f"""with {_CHATS} select row_id, md5(array_to_string(list_transform(list_filter(m, lambda x: trim(coalesce(x.content, ''), ' ') <> ''), lambda x: upper(x.role[1]) || x.role[2:] || ': ' || x.content), chr(10))) as digest from c""",
    "prj_rejected": f"""with {_CHATS}, x as (select row_id, list_max(list_transform(range(1, len(m)::bigint + 1), lambda i: case when m[i].role = 'user' then i else 0 end)) as lu from c)
select row_id, cast(lu + 1 as integer) as n, md5('I do not know.') as last from x where lu > 0""",
    "prj_exchanges": f"""with {_CHATS}, x as (select row_id, case when m[1].role = 'system' then m[2:] else m end as m from c), e as (select row_id, m, unnest(range(0, (len(m)::bigint + 1) // 2)) as k from x)
select row_id, cast(k as integer) as k, md5(m[2 * k + 1].content) as query, md5(m[2 * k + 2].content) as response from e""",
    "prj_tags": f"""with {_CHATS} select row_id, md5(repeat('<video>', greatest(0, 1 - cast(list_sum(list_transform(m, lambda x: coalesce(len(regexp_extract_all(x.content, '<video>')), 0))) as integer))) || coalesce(m[1].content, '')) as first from c""",
    "prj_thinking": f"""with {_CHATS}, x as (select row_id, m, list_max(list_transform(range(1, len(m)::bigint + 1), lambda i: case when m[i].role = 'user' then i else 0 end)) as lu from c)
select row_id, cast(len(list_filter(range(1, len(m)::bigint + 1), lambda i: m[i].role = 'assistant' and i > lu and m[i].content is not null)) as integer) as kept, cast(len(m) as integer) as n from x""",
    "prj_rl_rows": f"""with {_CHATS}, x as (select row_id, video_duration, m, list_max(list_transform(range(1, len(m)::bigint + 1), lambda i: case when m[i].role = 'assistant' then i else 0 end)) as la from c where video_duration > 0)
select row_id, printf('row-%06d', row_id) as id, 'The video lasts ' || printf('%.1f', round(video_duration, 1)) || 's.' as question, md5(case when la > 0 then m[la].content end) as solution from x""",
    "prj_arms": f"""with {_CHATS}, x as (select row_id, m, list_max(list_transform(range(1, len(m)::bigint + 1), lambda i: case when m[i].role = 'assistant' then i else 0 end)) as la,
  array_to_string(list_transform(list_filter(m, lambda x: trim(coalesce(x.content, ''), ' ') <> ''), lambda x: upper(x.role[1]) || x.role[2:] || ': ' || x.content), chr(10)) as f from c),
y as (select row_id, f, case when la > 0 then m[la].content end as r from x)
select row_id, 'graph' as arm, 'answer' as task, md5(r) as target from y union all select row_id, 'graph', 'auxiliary', md5(f) from y union all select row_id, 'baseline', 'answer', md5(r) from y union all select row_id, 'baseline', 'auxiliary', md5(r) from y""",
    "prj_cases": """with m as (select distinct row_id, video_id, kind from manifest), d as (select * from (values ('natural', 'original', 'released'), ('natural', 'original', 'factual'), ('natural', 'static_middle', 'released'),
  ('natural', 'static_middle', 'factual'), ('step', 'original', 'factual'), ('gray', 'gray', 'factual'), ('gray', 'gray_to_white', 'factual')) t(kind, c, p))
select row_id, concat_ws(':', video_id, c, p) as case_id from m join d using (kind)""",
    "prj_ranking_rows": """with l as (select l_orderkey, case when l_returnflag = 'R' then 1 else 0 end as label, 'order ' || l_orderkey || ' part ' || l_partkey as t from lineitem)
select l_orderkey, label, count(*) as n, min(t) as first from l group by 1, 2""",
    "prj_printable": """with t as (select doc_id, case when length(text) >= 1000 then '<<<' || substr(text, 1, 20) || '...' || length(text) || '>>>' else text end as t from documents)
select doc_id, md5(t) as digest, cast(length(t) as integer) as n from t""",
    "prj_overrides": "select distinct p_size, p_brand, 'brand=' || p_brand || ';kind=base;lr=0.1;size=' || p_size as settings from part",
    "prj_pairs_padded": """with d as (select distinct l_orderkey, l_partkey from lineitem), p as (select l_orderkey, list(l_partkey order by l_partkey)[1:4] as p from d group by 1),
i as (select l_orderkey, max(cast(floor(l_quantity) as integer) % 6) as i from lineitem group by 1),
x as (select l_orderkey, list_concat(p, list_transform(range(0, 4 - len(p)::bigint), lambda z: cast(-1 as bigint))) as p, i from p join i using (l_orderkey))
select l_orderkey, array_to_string(p, ',') as candidates, p[least(greatest(i - 1, 0), 3) + 1] as chosen from x""",
    "rwd_total": f"""with {PRED}, x as (select g.entity, g.label as gl, p.label as pl, case when greatest(g.e, p.e) - least(g.s, p.s) > 0 then greatest(least(g.e, p.e) - greatest(g.s, p.s), 0) / (greatest(g.e, p.e) - least(g.s, p.s)) else 0.0 end as iou
  from gt g join pred p on g.entity = p.entity and g.idx = p.idx),
two as (select entity, sum(iou) as iou, sum(case when gl = pl and iou > 0.5 then 1.0 else 0.0 end) as hits from x group by 1),
one as (select entity, count(*) as np, bool_and(e - s >= 400) as long_, avg(exp(-abs({_count("coalesce(reason, '')")} - 120) / 40.0)) as reason from pred group by 1), n as (select entity, count(*) as ng from gt group by 1)
select entity, round(0.1 * case when long_ then 0.7 else 0.5 end + 0.25 * exp(-abs(np - ng) / 1.5) + 0.25 * coalesce(iou, 0) / np + 0.25 * coalesce(hits, 0) / np + 0.15 * reason, 6) as reward from one join n using (entity) left join two using (entity)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        txt_word_counts, txt_reason_quality, txt_terms, txt_repetition, txt_json_object, txt_tags, txt_tool_calls, txt_paths, txt_quotes, txt_weights, num_kernels, num_hamming,
        num_boxes, num_caps, num_soft_match, prj_reshape, prj_flat, prj_rejected, prj_exchanges, prj_tags, prj_thinking, prj_rl_rows, prj_arms, prj_cases, prj_ranking_rows,
        prj_printable, prj_overrides, prj_pairs_padded, rwd_total,
    )
}
