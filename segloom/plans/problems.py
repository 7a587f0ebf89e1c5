"""Queries of the general data problems: continuous periods and gaps, and flat tables of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.operators import coverage, nested
from segloom.session import table

#: Holes of at most this length belong to a period.
BRIDGED_MS = 100


def _periods(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.periods(
        coverage.usable(table(spark, folder, "segments"), "video_id", "start_time", "end_time"), BRIDGED_MS
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    limits = (
        table(spark, folder, "manifest")
        .filter("video_duration > 0 and not isnan(video_duration)")
        .select(F.col("video_id").alias("entity"), F.round(F.col("video_duration") * 1000).cast("long").alias("limit_ms"))
    )
    return coverage.periods_and_gaps(_periods(spark, folder), limits, BRIDGED_MS).withColumnRenamed("entity", "video_id")


def p5_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per clip the number of periods and the covered milliseconds."""
    return (
        _periods(spark, folder)
        .groupBy(F.col("entity").alias("video_id"))
        .agg(F.count("*").alias("periods"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    labelled = nested.nodes(nested.turns(table(spark, folder, "train")), bodies=False)
    segments = nested.segment_table(labelled).select("row_id", "turn_no", "segment_no", F.lit(-1).cast("long").alias("pair_no"))
    pairs = nested.pair_table(labelled).select("row_id", "turn_no", "segment_no", "pair_no")
    return segments.unionByName(pairs).distinct()


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    """The table of records, one row an id."""
    return (
        table(spark, folder, "train")
        .select("row_id", "video", "video_duration", "source", F.coalesce(F.size("conversations"), F.lit(0)).alias("n"))
        .select("row_id", "video", "video_duration", "source", F.greatest("n", F.lit(0)).cast("long").alias("turns"))
        .distinct()
    )


def p6_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The table of turns, linked by ``row_id``."""
    return nested.turns(table(spark, folder, "train")).distinct()


def p6_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The table of segments with their scalar members, linked by ``row_id, turn_no``."""
    member = lambda *names: F.coalesce(*(F.get_json_object("body", f"$.{n}") for n in names))
    return (
        nested.segment_table(nested.nodes(nested.turns(table(spark, folder, "train"))))
        .select(
            "row_id",
            "turn_no",
            "segment_no",
            member("start_time", "start").try_cast("double").alias("start_time"),
            member("end_time", "end").try_cast("double").alias("end_time"),
            member("emotion").alias("emotion"),
            member("reason").alias("reason"),
            member("event").alias("event"),
            member("selected_pair_index").try_cast("int").alias("selected_pair_index"),
        )
        .distinct()
    )


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The table of candidate pairs, linked by ``row_id, turn_no, segment_no``."""
    return (
        nested.pair_table(nested.nodes(nested.turns(table(spark, folder, "train"))))
        .select(
            "row_id",
            "turn_no",
            "segment_no",
            "pair_no",
            F.get_json_object("body", "$.emotion").alias("emotion"),
            F.get_json_object("body", "$.reason").alias("reason"),
        )
        .distinct()
    )


def p6_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every table of the nested records: its schema path, the one above it, records and rows."""
    return nested.paths(nested.nodes(nested.turns(table(spark, folder, "train")), bodies=False))


_USABLE = """u as (select distinct video_id, try_cast(round(start_time * 1000) as bigint) as s, try_cast(round(end_time * 1000) as bigint) as e
  from segments where video_id is not null and abs(start_time) < 9e14 and abs(end_time) < 9e14
    and try_cast(round(end_time * 1000) as bigint) > try_cast(round(start_time * 1000) as bigint)),
m as (select video_id, s, e, max(e) over (partition by video_id order by s, e rows between unbounded preceding and 1 preceding) as r from u),
g as (select video_id, s, e, sum(case when r is null or s > r + 100 then 1 else 0 end)
  over (partition by video_id order by s, e rows unbounded preceding) as k from m),
p as (select video_id, min(s) as start_ms, max(e) as end_ms from g group by video_id, k)"""

VALUE = """v0 as (select distinct row_id, (i - 1) as turn_no, regexp_replace(conversations[i].value, '^\\s*```[a-zA-Z]*\\s*', '') as v
  from (select row_id, conversations, unnest(range(1, len(conversations) + 1)) as i from train where conversations is not null)
  where conversations[i]."from" = 'gpt' and conversations[i].value is not null),
v1 as (select row_id, turn_no, case when ltrim(v)[1] = '"' then case when json_valid(v) then json_extract_string(v, '$') end else v end as v from v0),
v2 as (select row_id, turn_no, regexp_extract(v, '(?s)[\\[{].*[\\]}]') as v from v1),
v3 as (select row_id, turn_no, cast(v as json) as j from v2 where v <> '' and json_valid(v)),
s as (select row_id, turn_no, case when json_type(j) = 'ARRAY' then j
  else coalesce(json_extract(j, '$.segments'), json_extract(j, '$.result.segments')) end as l from v3)"""

ORACLE = {
    "p5_found": f"""with {_USABLE},
n as (select video_id, start_ms, end_ms, lead(start_ms) over (partition by video_id order by start_ms) as nx,
  lag(end_ms) over (partition by video_id order by start_ms) as pv from p),
d as (select video_id, max(cast(round(video_duration * 1000) as bigint)) as lim from manifest
  where video_duration > 0 and not isnan(video_duration) group by video_id)
select video_id, 'period' as kind, start_ms, end_ms from p
union all select video_id, 'gap', end_ms, nx from n where nx is not null
union all select video_id, 'gap', 0, start_ms from n where pv is null and start_ms > 100
union all select video_id, 'gap', end_ms, lim from n join d using (video_id) where nx is null and lim - end_ms > 100""",
    "p5_coverage": f"""with {_USABLE}
select video_id, count(*) as periods, cast(sum(end_ms - start_ms) as bigint) as covered_ms from p group by video_id""",
    "p6_found": f"""with {VALUE},
e as (select row_id, turn_no, unnest(range(0, cast(json_array_length(l) as bigint))) as n, l from s where json_type(l) = 'ARRAY'),
c as (select row_id, turn_no, n, json_extract(l, '$[' || n || '].candidate_pairs') as q from e)
select row_id, turn_no, n as segment_no, cast(-1 as bigint) as pair_no from e
union select row_id, turn_no, n, unnest(range(0, cast(json_array_length(q) as bigint))) from c where json_type(q) = 'ARRAY'""",
    "p6_records": """select distinct row_id, video, video_duration, source, cast(coalesce(len(conversations), 0) as bigint) as turns from train""",
    "p6_turns": """select distinct row_id, i - 1 as turn_no, conversations[i]."from" as role, conversations[i].value as value
from (select row_id, conversations, unnest(range(1, len(conversations) + 1)) as i from train where conversations is not null)""",
    "p6_segments": f"""with {VALUE},
e as (select row_id, turn_no, n as segment_no, json_extract(l, '$[' || n || ']') as o
  from (select row_id, turn_no, unnest(range(0, cast(json_array_length(l) as bigint))) as n, l from s where json_type(l) = 'ARRAY'))
select distinct row_id, turn_no, segment_no,
  try_cast(coalesce(json_extract_string(o, '$.start_time'), json_extract_string(o, '$.start')) as double) as start_time,
  try_cast(coalesce(json_extract_string(o, '$.end_time'), json_extract_string(o, '$.end')) as double) as end_time,
  json_extract_string(o, '$.emotion') as emotion, json_extract_string(o, '$.reason') as reason, json_extract_string(o, '$.event') as event,
  try_cast(json_extract_string(o, '$.selected_pair_index') as integer) as selected_pair_index from e""",
    "p6_paths": f"""with {VALUE},
t as (select row_id, turn_no, case when json_type(j) = 'ARRAY' then '[]' when json_extract(j, '$.segments') is not null then 'segments[]' else 'result.segments[]' end as path,
  case when json_type(j) = 'ARRAY' then j else coalesce(json_extract(j, '$.segments'), json_extract(j, '$.result.segments')) end as l from v3),
e as (select row_id, turn_no, path, unnest(range(0, cast(json_array_length(l) as bigint))) as n, l from t where json_type(l) = 'ARRAY'),
c as (select row_id, path, json_extract(l, '$[' || n || '].candidate_pairs') as q from e),
x as (select row_id, path, unnest(range(0, cast(json_array_length(q) as bigint))) as m from c where json_type(q) = 'ARRAY')
select path as schema_path, '' as parent_path, count(distinct row_id) as records, count(*) as nodes from e group by path
union all select path || '.candidate_pairs[]', path, count(distinct row_id), count(*) from x group by path""",
    "p6_pairs": f"""with {VALUE},
e as (select row_id, turn_no, unnest(range(0, cast(json_array_length(l) as bigint))) as n, l from s where json_type(l) = 'ARRAY'),
c as (select row_id, turn_no, n as segment_no, json_extract(l, '$[' || n || '].candidate_pairs') as q from e),
x as (select row_id, turn_no, segment_no, unnest(range(0, cast(json_array_length(q) as bigint))) as pair_no, q from c where json_type(q) = 'ARRAY')
select distinct row_id, turn_no, segment_no, pair_no, json_extract_string(q, '$[' || pair_no || '].emotion') as emotion,
  json_extract_string(q, '$[' || pair_no || '].reason') as reason from x""",
}

QUERIES = {f.__name__: f for f in (p5_found, p5_coverage, p6_found, p6_records, p6_turns, p6_segments, p6_pairs, p6_paths)}
