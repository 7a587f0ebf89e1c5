"""Streams over folders that grow: resumable stages, islands by session, running label statistics.

The reference data has no event-time streams; these are extensions. Each is a bounded-state query: watermarks drop the
state of closed windows, and a stage's progress is its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", files_a_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_a_trigger).load(folder)


def stage(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs a stage over what is there and not done yet, then stops; started again it goes on where it was.

    Each micro-batch is written under its number, so a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events without a longer gap between them."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def label_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in windows of a fixed width."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
