"""The queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.llm import lookalike, mixing, overlap, packing, pairs, runs, tokens, truncation
from segloom.session import durable, table

#: A vocabulary is a fixed list; more entries than this are taken for a mistake.
MOST_LABELS = 10_000


def vocabulary(spark: SparkSession, folder: str) -> dict[str, str]:
    rows = table(spark, folder, "emotion_vocab").select("emotion", "canonical_emotion").limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"emotion_vocab has more than {MOST_LABELS} rows")
    return {r.emotion: r.canonical_emotion for r in rows if r.emotion and r.canonical_emotion}


def _events(spark: SparkSession, folder: str) -> DataFrame:
    segments = table(spark, folder, "segments")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(9e14))
    return (
        segments.filter(finite("start_time") & finite("end_time"))
        .select(
            F.col("video_id").alias("entity"), F.col("segment_id").alias("id"), F.col("emotion").alias("label"),
            ms("start_time").alias("start_ms"), ms("end_time").alias("end_ms"),
        )
        .filter("end_ms > start_ms")
    )


def p3_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of the usable events with its count and duration, those of one event too."""
    return runs.collapse_runs(_events(spark, folder), vocabulary(spark, folder)).select(
        F.col("entity").alias("video_id"),
        F.col("first_id").alias("first_segment_id"),
        F.col("last_id").alias("last_segment_id"),
        "events",
        F.col("label").alias("emotion"),
        "start_ms",
        "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_runs(spark, folder).filter("events > 1").select("video_id", "first_segment_id", "last_segment_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.alike(durable(lookalike.classes(table(spark, folder, "documents"))))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of texts that look like its own, and the number of spellings in the class."""
    keys = lookalike.classes(table(spark, folder, "documents"))
    size = keys.groupBy("form").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("documents"), F.countDistinct("spelling").alias("spellings"))
    return keys.join(size, "form").select("doc_id", "class_id", "documents", "spellings")


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its consistent form."""
    return lookalike.consistent(table(spark, folder, "documents"))


def _evaluation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "test"), table(spark, folder, "manifest").filter(F.col("split_name").isin("dev", "study"))


def _clips(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    train = table(spark, folder, "train")
    test, manifest = _evaluation(spark, folder)
    names = overlap.clip_keys(test, "video").unionByName(overlap.clip_keys(manifest, "video_id"))
    return tuple(map(durable, (overlap.clip_keys(train, "video"), names, overlap.contents(train), overlap.contents(test))))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    train_keys, eval_keys, train_contents, eval_contents = _clips(spark, folder)
    return overlap.same_name(train_keys, eval_keys).unionByName(overlap.same_content(train_contents, eval_contents)).distinct()


def p2_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that is in both splits with its class and the number of its links, copies not expanded."""
    return overlap.clips(*_clips(spark, folder))


def p2_near_names(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of both sides that are an edit apart and yet other clips, for review."""
    train_keys, eval_keys, _, _ = _clips(spark, folder)
    near = overlap.near_names(train_keys, eval_keys, edits=1)
    return near.join(overlap.linked_names(train_keys, eval_keys, edits=1), ["query", "base"], "left_anti")


def p2_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Per split and source: evaluation records, those that training has too, and the pairs."""
    test, manifest = _evaluation(spark, folder)
    rows = (
        test.select("row_id", F.lit("test").alias("split"), "source")
        .unionByName(manifest.select("row_id", F.col("split_name").alias("split"), "source"))
        .dropDuplicates(["row_id"])
    )
    hits = p2_found(spark, folder).groupBy(F.col("eval_row_id").alias("row_id")).agg(F.count("*").alias("n"))
    return rows.join(hits, "row_id", "left").groupBy("split", "source").agg(
        F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")
    )


#: Finish reasons of a run that was stopped.
STOPPED = ("length", "abort", "error")


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    outputs = table(spark, folder, "outputs").select(
        F.lit("outputs").alias("record_table"),
        F.col("output_id").alias("record_id"),
        F.lit(0).cast("long").alias("turn_no"),
        F.col("prompt").alias("question"),
        F.col("raw_output").alias("answer"),
        F.col("finish_reason").isin(*STOPPED).alias("stopped"),
    )
    turns = pairs.conversation_pairs(table(spark, folder, "train"), "train").withColumn("stopped", F.lit(None).cast("boolean"))
    return turns.unionByName(outputs)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken(_answers(spark, folder))


def p1_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of answers foreign to descriptions that recur under unrelated questions or decline, with their clusters."""
    found = pairs.templates(*pairs.candidates(durable(pairs.judged(_answers(spark, folder)))))
    return found.filter((F.col("questions") >= pairs.UNRELATED) | F.col("declining")).drop("id")


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    outputs = table(spark, folder, "outputs").select(
        F.col("output_id").alias("id"), "source", F.col("finish_reason").isin(*STOPPED).alias("stopped"), F.col("raw_output").alias("text"), F.col("generated_tokens").alias("tokens")
    )
    return durable(truncation.readings(outputs))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut(_readings(spark, folder)).select(F.col("id").alias("output_id"))


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per source the texts, the cut ones, those cut at a limit, and the share of cut ones."""
    read = _readings(spark, folder)
    rows = read.select("id", "source").join(truncation.cut(read).select("id", "at_limit"), "id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.count("at_limit").alias("cut"),
        F.count_if("at_limit").alias("cut_at_limit"),
        (F.count("at_limit") / F.count("*")).alias("share"),
    )


def p4_rules(spark: SparkSession, folder: str) -> DataFrame:
    """How many cut texts each rule decides, and how many of them lie at a limit."""
    return truncation.cut(_readings(spark, folder)).groupBy("rule").agg(F.count("*").alias("texts"), F.count_if("at_limit").alias("at_limit"))


def p4_limits(spark: SparkSession, folder: str) -> DataFrame:
    """The hidden limits of each source, by the way of counting that exposes them."""
    return truncation.limits(_readings(spark, folder)).drop("v")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return durable(tokens.sizes(table(spark, folder, "documents"), tokens.ranks_path(spark)))


def _capacities(spark: SparkSession, folder: str) -> dict[str, int]:
    rows = table(spark, folder, "pack_capacity").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("pack_capacity has more than 1000 rows")
    return {r.container_kind: r.capacity_tokens for r in rows}


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's container (or those of its pieces) for each capacity."""
    return packing.pack(_sizes(spark, folder), _capacities(spark, folder))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity the containers and the share of their room that is used."""
    return packing.fill(p7_packed(spark, folder), table(spark, folder, "pack_capacity"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix in order of training."""
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "mix_targets"))


def p7_violations(spark: SparkSession, folder: str) -> DataFrame:
    """How often the packing breaks one of its rules."""
    sizes, capacities = _sizes(spark, folder), _capacities(spark, folder)
    if not capacities:
        return spark.createDataFrame([], "rule string, cases long")
    return packing.violations(durable(packing.pack(sizes, capacities)), sizes, capacities)


def p8_violations(spark: SparkSession, folder: str) -> DataFrame:
    """How often the mix breaks one of its rules; a share is off if it misses its target by more than 0.02."""
    sizes, targets = _sizes(spark, folder), table(spark, folder, "mix_targets")
    return mixing.violations(durable(mixing.mix(sizes, targets)), sizes, targets)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mix really reaches."""
    return mixing.shares(p8_mix(spark, folder), table(spark, folder, "mix_targets"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_templates, p2_found, p2_overlaps, p2_clips, p2_near_names, p3_found, p3_runs, p4_found, p4_shares, p4_limits, p4_rules, p7_packed, p7_fill, p7_violations, p8_mix, p8_shares, p8_violations,
        p9_found, p9_classes, p9_forms,
    )
}
_RUNS = """v as (select regexp_replace(lower(emotion), '[^a-z0-9]', '', 'g') as f, canonical_emotion as c from emotion_vocab),
d as (select distinct emotion, regexp_replace(lower(emotion), '[^a-z0-9]', '', 'g') as f from segments where emotion is not null),
n as (select emotion, c, case when d.f = v.f then 0 else damerau_levenshtein(d.f, v.f) end as k, case when length(v.f) >= 8 then 2 else 1 end as most from d join v on true),
b as (select emotion, min(k) as k from n where k <= most group by 1), u as (select emotion, min(c) as c, count(distinct c) as m from n join b using (emotion, k) where k <= most group by 1),
s as (select distinct segment_id as id, video_id, cast(round(start_time * 1000) as bigint) as s, cast(round(end_time * 1000) as bigint) as e, emotion from segments
  where video_id is not null and not isnan(start_time) and not isnan(end_time)),
l as (select s.*, case when u.m = 1 then u.c else s.emotion end as label from s left join u using (emotion) where e > s),
c as (select *, case when lag(label) over w = label then 0 else 1 end as c from l window w as (partition by video_id order by s, id)),
g as (select *, sum(c) over (partition by video_id order by s, id rows unbounded preceding) as g from c)"""
# A form for comparing in SQL, by its own letters (fixed values): invisible characters out, widths, spaces and look-alikes exchanged
# one by one, accents composed. It makes every look-alike Latin, which parts and joins the same texts.
_PAIRS = (
    "аa АA еe ЕE һh НH іi ІI јj ЈJ КK оo ОO рp РP сc СC ѕs ЅS ТT уy УY хx ХX ԁd ԛq ԝw ӏl ВB МM ѵv νv οo ΟO ρp υu ιi ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΡP ΤT ΥY ΧX ոn սu օo ցg ɡg ɑa"
).split()
_FROM = "".join(p[0] for p in _PAIRS) + "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000\u0451\u0401\u0457\u0407"
_TO = "".join(p[1] for p in _PAIRS) + "".join(map(chr, range(0x21, 0x7F))) + " " * 16 + "\u00eb\u00cb\u00ef\u00cf"
_FORMS = f"""f as (select distinct doc_id, text, nfc_normalize(translate(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '[\\x{{00AD}}\\x{{034F}}\\x{{061C}}\\x{{180E}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{2066}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g'),
  '{_FROM.replace("'", "''")}', '{_TO.replace("'", "''")}')) as form from documents where text is not null)"""
# Endings in SQL: JSON from its first to its last bracket has to be valid; prose has to end in punctuation and without a mark.
_CUT = """o as (select distinct output_id, source, raw_output as t from outputs where raw_output is not null),
a as (select *, regexp_replace(t, '^\\s*```[a-zA-Z]*\\s*', '') as b from o),
k as (select *, length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) = 0 or regexp_matches(lower(trim(t)), '^[<\\[(`\\s]*(\\|?[a-z/]*\\|?|none|null|n/a|empty|json|answer|answer></answer)[>\\])`.\\s]*$') as blank,
  regexp_matches(b, '^\\s*("?[{\\[]|[^\\[{]{0,60}:\\s*[{\\[])') as json from a),
c as (select output_id, source, case when blank then false
  when json and ltrim(b)[1] = '"' then not json_valid(rtrim(regexp_replace(b, '\\s*```\\s*$', '')))
  when json then not json_valid(regexp_extract(b, '(?s)[\\[{].*[\\]}]', 0))
  else regexp_matches(t, '(\\.\\.\\.|…|[\\[<(](truncated|cut|\\.\\.\\.)[\\])>])\\s*["”»]*\\s*$') or
    (not regexp_matches(t, '[.!?。！？](\\s|```|["”»)\\]]|<\\|?[a-z]+\\|?>|\\p{So})*$') and regexp_matches(t, '\\S\\s+\\S')) end as cut from k)"""
_N = lambda c: f"(length(t) - length(replace(t, {c}, '')))"
_ENTITIES = f"""(4 * {_N("'&'")} + 3 * {_N("'<'")} + 3 * {_N("'>'")} + 5 * {_N("chr(34)")} + 5 * {_N("chr(39)")})"""
_SHORT = "(" + " + ".join(map(_N, ("chr(34)", "chr(92)", "chr(10)", "chr(13)", "chr(9)"))) + ")"
_ASTRAL = "length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"
_WIDE = f"(5 * (length(regexp_replace(t, '[\\x{{0000}}-\\x{{007F}}]', '', 'g')) - {_ASTRAL}) + 11 * {_ASTRAL})"
_CRLF = f"({_N('chr(10)')} - (length(t) - length(replace(t, chr(13) || chr(10), ''))) // 2)"
_LENGTHS = {
    "points": "length(t)", "utf16": f"length(t) + {_ASTRAL}", "bytes": "strlen(t)", "entities": f"length(t) + {_ENTITIES}", "entity_bytes": f"strlen(t) + {_ENTITIES}",
    "json": f"length(t) + {_SHORT} + {_WIDE}", "json_bytes": f"strlen(t) + {_SHORT}", "crlf": f"length(t) + {_CRLF}", "crlf_bytes": f"strlen(t) + {_CRLF}", "tokens": "generated_tokens",
}
_LIMITS = f"""{_CUT.replace("source, raw_output as t", "source, generated_tokens, raw_output as t").replace("select output_id, source, case", "select output_id, source, generated_tokens, t, case")},
h as (select output_id, source, cut, unnest([{", ".join(f"{{'variant': '{v}', 'length': cast({x} as int)}}" for v, x in _LENGTHS.items())}], recursive := true) from c),
y as (select source, variant, length, count(*) as texts, count(*) filter (where cut) as broken from h where length >= 64 group by all),
w as (select *, (sum(texts) over (partition by source, variant order by length range between 10 preceding and 10 following) - texts) / 20.0 as around from y),
m as (select source, variant, length, texts, broken from w where texts >= 5 and texts >= 4 * (1 + around) and broken >= 0.5 * texts)"""
_AT = """z as (select distinct h.output_id from h join m on h.source is not distinct from m.source and h.variant = m.variant
  and h.length between m.length - case when m.variant = 'tokens' then 0 else 3 end and m.length where h.cut)"""
_NONE = lambda rules: "select * from (values " + ", ".join(f"('{r}', cast(0 as bigint))" for r in rules) + ") v(rule, cases)"
ORACLE = {
    "p7_violations": _NONE(["over capacity", "not whole", "split for nothing"]),
    "p8_violations": _NONE(["unlike its record", "used too often", "twice in a pass", "off its share", "out of time"]),
    "p4_limits": f"with {_LIMITS} select * from m",
    "p4_shares": f"""with {_LIMITS}, {_AT} select source, count(*) as texts, count(*) filter (where cut) as cut, count(z.output_id) as cut_at_limit, count(*) filter (where cut) / count(*) as share
from c left join z using (output_id) group by source""",
    "p4_found": f"with {_CUT} select output_id from c where cut",
    "p9_found": f"""with {_FORMS} select a.doc_id as doc_id_a, b.doc_id as doc_id_b from f a join f b on a.form = b.form and a.text <> b.text and a.doc_id < b.doc_id""",
    "p9_classes": f"""with {_FORMS}, c as (select form, min(doc_id) as class_id, count(*) as documents, count(distinct text) as spellings from f group by 1) select doc_id, class_id, documents, spellings from f join c using (form)""",
    "p3_found": f"""with {_RUNS}
select video_id, first(id order by s, id) as first_segment_id, last(id order by s, id) as last_segment_id from g group by video_id, g having count(*) > 1""",
    "p3_runs": f"""with {_RUNS}
select video_id, first(id order by s, id) as first_segment_id, last(id order by s, id) as last_segment_id, count(*) as events, any_value(label) as emotion, min(s) as start_ms, max(e) as end_ms, max(e) - min(s) as duration_ms
from g group by video_id, g""",
}
