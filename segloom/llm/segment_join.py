"""Edit-distance join of strings by segments.

A query string that may lie ``k`` edits from a base string is cut into ``k + 1`` segments; at least one of them is
intact in the base string, at a position that the lengths and the number of segments before it bound. So base
substrings at the allowed positions are matched with the query segments by an equi-join, and the pairs that meet are
verified by a dynamic programme over the band of width ``k`` around the diagonal (``levenshtein`` with a threshold).

Strings only meet within a block, a key that both sides have to share. The blocks of both sides are intersected first, by
their hashes alone; texts of other blocks are never moved. The base side is cut only for the lengths that its block is
asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.session import durable, narrowed


def _allowed(length: Column, share: float | None, edits: int) -> Column:
    return F.lit(edits) if share is None else F.floor(length * F.lit(share)).cast("int")


def _cut(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i; the last ``length mod (k + 1)`` segments have one more character."""
    parts = k + 1
    size = F.floor(length / parts).cast("int")
    longer = length - size * parts
    late = F.greatest(F.lit(0), i - (parts - longer))
    return i * size + late, size + F.when(i >= parts - longer, 1).otherwise(0)


def segment_join(queries: DataFrame, base: DataFrame, edits: int = 1, share: float | None = None) -> DataFrame:
    """``query_id, base_id, distance`` of the pairs within ``edits``, or within ``share`` of the query's length.

    Both sides have ``block, id, text``; a query may have several blocks, and each pair comes out once. Rows may repeat;
    give each distinct text one id and expand copies afterwards. Null blocks or texts meet nothing; an empty text meets the texts
    of at most ``k`` characters in its block. Nothing is dropped: no bound on candidates or lengths.
    """
    keyed = lambda df: df.filter("block is not null and text is not null").select(F.xxhash64("block").alias("block"), "id", "text")
    queries, base = keyed(queries), keyed(base)
    common = durable(queries.select("block").distinct().join(base.select("block").distinct(), "block", "left_semi"))
    queries, base = narrowed(queries, common, "block").distinct(), narrowed(base, common, "block").distinct()
    q = queries.select("block", F.col("id").alias("query_id"), F.col("text").alias("q"))
    q = q.withColumn("l", F.char_length("q")).withColumn("k", _allowed(F.col("l"), share, edits))
    asked = q.select("block", "l", "k").distinct()
    b = base.select("block", F.col("id").alias("base_id"), F.col("text").alias("b"))
    b = b.withColumn("m", F.char_length("b")).join(asked, "block").filter(F.abs(F.col("m") - F.col("l")) <= F.col("k"))
    # A segment is known by a hash of its block, the query's length, its number and its text: a chance hit is a candidate more.
    known = lambda i, s: F.xxhash64("block", "l", i, s)

    def windows(i: Column) -> Column:
        start, size = _cut(F.col("l"), F.col("k"), i)
        shift = F.col("m") - F.col("l")
        low = F.greatest(F.lit(0), start - i, start + shift - (F.col("k") - i))
        high = F.least(F.col("m") - size, start + i, start + shift + (F.col("k") - i))
        at = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: known(i, F.substr(F.col("b"), p + 1, size)))

    def segments(i: Column) -> Column:
        start, size = _cut(F.col("l"), F.col("k"), i)
        return known(i, F.substr(F.col("q"), start + 1, size))

    numbers = F.sequence(F.lit(0), F.col("k"))
    left = q.select("query_id", F.explode(F.transform(numbers, segments)).alias("segment"))
    right = b.select("base_id", F.explode(F.array_distinct(F.flatten(F.transform(numbers, windows)))).alias("segment"))
    met = left.join(right, "segment").select("query_id", "base_id").distinct()
    texts = lambda df, name, col: df.select(F.col("id").alias(name), F.col("text").alias(col)).distinct()
    pairs = met.join(texts(queries, "query_id", "q"), "query_id").join(texts(base, "base_id", "b"), "base_id")
    k = _allowed(F.char_length("q"), share, edits)
    pairs = pairs.withColumn("k", k).withColumn("distance", F.expr("levenshtein(q, b, k)"))
    return pairs.filter("distance >= 0").select("query_id", "base_id", "distance")
