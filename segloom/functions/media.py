"""Sizes, frame numbers, hashes and histograms of media, from numbers that a decoder gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The largest ratio of sides, the least and the most pixels in units of a factor's square, and the frames' bounds.
MOST_RATIO, LEAST_UNITS, MOST_UNITS = 200, 4, 16384
FRAME_FACTOR, FRAMES_A_SECOND, LEAST_FRAMES, MOST_FRAMES = 2, 2.0, 4, 768


def fitted(height: Column, width: Column, factor: int, least: int | None = None, most: int | None = None) -> Column:
    """``height, width`` divisible by the factor, with the pixels between ``least`` and ``most`` and nearly the same ratio.

    Halves round to the even number. Null where the ratio of the sides exceeds MOST_RATIO or a side is missing.
    """
    least = LEAST_UNITS * factor**2 if least is None else least
    most = MOST_UNITS * factor**2 if most is None else most
    if most < least:
        raise ValueError("the most pixels are fewer than the least")
    near = lambda x: F.greatest(F.lit(factor), (F.bround(x / factor) * factor).cast("long"))
    h, w, pixels = near(height), near(width), height.cast("double") * width
    big, small = F.sqrt(pixels / most), F.sqrt(F.lit(float(least)) / pixels)
    down = lambda x: (F.floor(x / big / factor) * factor).cast("long")
    up = lambda x: (F.ceil(x * small / factor) * factor).cast("long")
    side = lambda x, v: F.when(h * w > most, down(x)).when(h * w < least, up(x)).otherwise(v)
    usable = F.greatest(height, width) / F.least(height, width) <= MOST_RATIO
    return F.when(usable, F.struct(side(height, h).alias("height"), side(width, w).alias("width")))


def frame_count(total: Column, rate: Column, wanted_rate: float = FRAMES_A_SECOND, least: int = LEAST_FRAMES, most: int = MOST_FRAMES) -> Column:
    """Frames to take of ``total`` at ``rate`` a second, a multiple of FRAME_FACTOR; null where that isn't possible."""
    even = lambda x: (F.floor(x / FRAME_FACTOR) * FRAME_FACTOR).cast("long")
    low, high = -(-least // FRAME_FACTOR) * FRAME_FACTOR, even(F.least(F.lit(most), total))
    n = even(F.least(F.least(F.greatest(total / rate * wanted_rate, F.lit(float(low))), high.cast("double")), total.cast("double")))
    return F.when((n >= FRAME_FACTOR) & (n <= total), n)


def steps(rows: Column, batch: int, epochs: float) -> Column:
    """Training steps: whole batches (one at least) times epochs, rounded up."""
    return F.ceil(F.lit(epochs) * F.greatest(F.lit(1), F.floor(rows / batch))).cast("long")


def average_bits(values: Column) -> Column:
    """Of an array of brightness values: for each whether it is above their mean, as text of 0 and 1, first value first."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    pair = F.struct(values.alias("v"), mean.alias("m"))
    return F.get(F.transform(F.array(pair), lambda p: F.array_join(F.transform(p["v"], lambda x: F.when(x > p["m"], "1").otherwise("0")), "")), 0)


def differing(a: Column, b: Column) -> Column:
    """Places at which two texts of bits differ."""
    return F.size(F.filter(F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda z: z["a"] != z["b"]))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms: 0 for equal shapes, 1 without a common bin; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    common = total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(common, F.sqrt(total(a) * total(b)))))


def lower_bound(values: Column, x: Column) -> Column:
    """The first place of a sorted array at which ``x`` could be put before equals."""
    return F.size(F.filter(values, lambda v: v < x))


def upper_bound(values: Column, x: Column) -> Column:
    """The last such place, after equals."""
    return F.size(F.filter(values, lambda v: v <= x))


def delimited(text: Column, pattern: str) -> Column:
    """Parts ``key, content`` of a text at delimiters (a regular expression); what stands before the first has the key ''."""
    keys = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    return F.zip_with(keys, F.split(text, pattern), lambda k, c: F.struct(k.alias("key"), c.alias("content")))


def soft_f1(reference: Column, candidate: Column) -> Column:
    """F1 of two maps of arguments: 1 for a key with its value, one half for the key alone; two empty ones agree."""
    full = F.size(F.filter(F.map_keys(reference), lambda k: F.map_contains_key(candidate, k) & F.element_at(reference, k).eqNullSafe(F.element_at(candidate, k))))
    key = F.size(F.filter(F.map_keys(reference), lambda k: F.map_contains_key(candidate, k)))
    hits, r, c = (full + key) / 2, F.size(reference), F.size(candidate)
    return F.when((r == 0) & (c == 0), 1.0).otherwise(F.coalesce(F.try_divide(2 * hits, (r + c).cast("double")), F.lit(0.0)))
