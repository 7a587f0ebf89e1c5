"""Deterministic samples, splits and shards by hash order, and the arithmetic of places in an order.

A place in the order of all rows comes from ``ordered.scan`` over one range-partitioned order, so nothing is sorted in one
task. Hash orders are of the text ``seed:key``, so they're the same on any layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.operators.ordered import scan


def hashed(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``rn``, the place in the order of the keys from 0, and ``total``, the number of rows."""
    total = df.agg(F.count("*").alias("total"))
    rows = scan(df.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1)), "_all", keys, sums=["_one"])
    return rows.withColumn("rn", F.col("run__one") - 1).drop("_all", "_one", "run__one").join(F.broadcast(total))


def sample_count(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by hash order; if there are fewer, every row n // size times and the remainder by hash order. Adds ``copies``."""
    rows = placed(df.withColumn("_h", hashed(key, seed)), ["_h", key])
    copies = F.floor(F.lit(n) / F.col("total")) + F.when(F.col("rn") < F.lit(n) % F.col("total"), 1).otherwise(0)
    return rows.withColumn("copies", copies).filter("copies > 0").drop("_h", "rn", "total")


def sample_share(df: DataFrame, key: str, percent: float, seed: int) -> DataFrame:
    """Rows whose hash falls into the first percent of 10,000 buckets."""
    bucket = F.conv(F.substring(hashed(key, seed), 1, 8), 16, 10).cast("long") % 10_000
    return df.filter(bucket < int(percent * 100))


def linspace_shard(n: int) -> Column:
    """Contiguous shards whose bounds are i * total / n, rounded down."""
    return F.greatest(F.lit(0), F.floor(((F.col("rn") + 1) * n - 1) / F.col("total"))).cast("int")


def even_shard(n: int) -> Column:
    """Contiguous shards, the first (total mod n) one longer."""
    q, r = F.floor(F.col("total") / n), F.col("total") % n
    return F.when(F.col("rn") < r * (q + 1), F.floor(F.col("rn") / (q + 1))).otherwise(r + F.floor((F.col("rn") - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int")


def round_robin(n: int) -> Column:
    return (F.col("rn") % n).cast("int")
