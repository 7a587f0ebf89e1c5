"""Group-relative statistics of rewards and selections within groups.

Groups (the samples of one prompt) are joined with their aggregates instead of being collected by a window, so partial
aggregation takes the size of a group down before the shuffle and a group of any share of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("group_n", "group_mean", "group_std")


def with_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds size, mean and sample deviation of the group; a group of one has the deviation 0. NaN values count as null."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    by = df.groupBy(group).agg(F.count(x).alias("group_n"), F.avg(x).alias("group_mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("group_std"))
    return df.join(by, group)


def centred(value: Column) -> Column:
    return value - F.col("group_mean")


def leave_one_out(value: Column) -> Column:
    """Against the mean of the others; 0 for a group of one."""
    n = F.col("group_n")
    return F.when(n > 1, (value - F.col("group_mean")) * n / (n - 1)).otherwise(0.0)


def scaled(advantage: Column, deviation: Column, epsilon: float = 1e-4) -> Column:
    return advantage / (deviation + epsilon)


def weighted_sum(rewards: list[Column], weights: list[float]) -> Column:
    """The weighted sum without the rewards that are null or NaN."""
    parts = [F.coalesce(F.nanvl(r.cast("double"), F.lit(None).cast("double")), F.lit(0.0)) * w for r, w in zip(rewards, weights)]
    return sum(parts[1:], parts[0])


def varied(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows of groups whose values differ."""
    by = df.groupBy(group).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a < _b").select(group)
    return df.join(by, group, "left_semi")


def last_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in the order; by one aggregation, not a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_m")
    return df.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_m._row.{c}").alias(c) for c in rest))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    top = F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_m")
    return df.groupBy(*keys).agg(top).select(*keys, *(F.col(f"_m._row.{c}").alias(c) for c in rest))
