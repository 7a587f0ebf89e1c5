"""Carriers that several queries share, in Spark and in SQL.

``seg``: the usable segments once an id, in whole milliseconds. ``gt`` numbers them within the clip; ``pred`` is a changed
copy (rows left out, times shifted, labels replaced), numbered likewise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.operators.segments import numbered
from segloom.session import table

SEG = """seg as (select distinct segment_id as id, video_id as entity, cast(round(start_time * 1000) as bigint) as s,
  cast(round(end_time * 1000) as bigint) as e, emotion as label, reason from segments
  where video_id is not null and not isnan(start_time) and not isnan(end_time) and end_time > start_time + 0.0005)"""
GT = SEG + """,
gt as (select entity, row_number() over (partition by entity order by s, id) - 1 as idx, s, e, label, reason, id from seg)"""
PRED = GT + """,
p0 as (select id, entity, greatest(s + ((id % 5) - 2) * 200, 0) as s, e + ((id % 3) - 1) * 300 as e,
  case when id % 4 = 0 then 'Interest' else label end as label, reason from seg where id % 7 <> 0),
pred as (select entity, row_number() over (partition by entity order by s, id) - 1 as idx, s, e, label, reason, id from p0 where e > s)"""


def seg(spark: SparkSession, folder: str) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return (
        table(spark, folder, "segments")
        .filter("video_id is not null and not isnan(start_time) and not isnan(end_time) and end_time > start_time + 0.0005")
        .select(F.col("segment_id").alias("id"), F.col("video_id").alias("entity"), ms("start_time").alias("s"), ms("end_time").alias("e"), F.col("emotion").alias("label"), "reason")
        .dropDuplicates(["id"])
    )


def gt(spark: SparkSession, folder: str) -> DataFrame:
    return numbered(seg(spark, folder), "entity", ["s", "id"])


def pred(spark: SparkSession, folder: str) -> DataFrame:
    changed = (
        seg(spark, folder)
        .filter("id % 7 <> 0")
        .select(
            "id",
            "entity",
            F.expr("greatest(s + ((id % 5) - 2) * 200, 0)").alias("s"),
            F.expr("e + ((id % 3) - 1) * 300").alias("e"),
            F.expr("case when id % 4 = 0 then 'Interest' else label end").alias("label"),
            "reason",
        )
        .filter("e > s")
    )
    return numbered(changed, "entity", ["s", "id"])
