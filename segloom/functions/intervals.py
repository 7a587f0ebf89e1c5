"""Column expressions on intervals and their numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_decimal(x: Column) -> Column:
    """Rounded half up to one decimal."""
    return F.round(x, 1)


def clamp(x: Column, low: Column, high: Column) -> Column:
    """At least low, at most high; high counts where low is above it. Null and NaN stay."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part, 0 if there is none."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common part over hull; 0 where the hull has no length."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap(s1, e1, s2, e2) / hull).otherwise(0.0)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def nearest(x: Column, points: Column, window: Column) -> Column:
    """The point nearest to x within the window (inclusive), the earlier one on a tie; null if there is none."""
    near = F.transform(F.filter(points, lambda c: F.abs(c - x) <= window), lambda c: F.struct(F.abs(c - x).alias("d"), c.alias("c")))
    return F.array_min(near)["c"]


def even_indices(n: Column, k: Column) -> Column:
    """k indices evenly from 0 to n - 1 (ends included, truncated); all of them where n is at most k."""
    step = lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int")
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(
        F.transform(F.sequence(F.lit(0), k - 1), step)
    )


def middle_frame(s: Column, e: Column, fps: Column, n: Column) -> Column:
    """The frame in the middle of an interval, within 0 and n - 1."""
    return F.least(n - 1, F.greatest(F.lit(0), F.floor((s + e) / 2 * fps).cast("int")))


def frame_range(s: Column, e: Column, fps: Column, n: Column) -> Column:
    """``first, last`` frame of a time range (start rounded up, end down, clamped); null where the range is empty."""
    first = F.greatest(F.lit(0), F.least(n - 1, F.ceil(s * fps).cast("int")))
    last = F.greatest(F.lit(0), F.least(n - 1, F.floor(e * fps).cast("int")))
    return F.when(first < last, F.struct(first.alias("first"), last.alias("last")))


def one_decimal_only(x: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(x - F.round(x, 1)) < tolerance
