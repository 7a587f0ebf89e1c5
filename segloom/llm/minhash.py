"""Clusters of near texts by MinHash and a prefix join, with verified Jaccard similarity.

A text is the set of its runs of five words (a shorter one the run of all its words). Only pairs of the wanted similarity,
computed from the sets themselves, are links; clusters are the components of the links.

Bands of a MinHash signature come first: the members of a band's group are compared with the least and the greatest id
among them, so a group of n costs 2 n comparisons, and families of near texts become components. That misses pairs. The
rest is exact: two sets of similarity s share a member among the first n - ceil(s n) + 1 of each, in an order common to
all (the rarest first), so texts that meet in such a prefix and lie in different components are all compared, unless
their sizes or places show that they can't be alike. So every two texts of the wanted similarity lie in one cluster.
Groups of a prefix member are joined in blocks, a hot one by many tasks, and what lies in the largest component of a
group is compared with the others of it only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.operators.components import components
from segloom.session import durable, joined, narrowed

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 10, 4
#: Members of a block in the join of a group with itself.
BLOCK = 1000
#: Slack of bounds that are computed with the similarity; it only lets more pairs through to the exact test.
SLACK = 1e-6


def _mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A 64-bit hash of each value under a salt (the finishing steps of splitmix64, wrapping)."""
    with np.errstate(over="ignore"):
        z = x * np.uint64(0x9E3779B97F4A7C15) + salt
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> list[int]:
    parts = text.split()
    if not parts:
        return []
    n = max(1, len(parts) - words + 1)
    return sorted({zlib.crc32(" ".join(parts[i : i + words]).encode()) for i in range(n)})


def _bands(bands: int, rows: int, words: int, seed: int = 20250301):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        salts = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64)
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            keep = np.flatnonzero(sizes)
            if not len(keep):
                continue
            flat = np.fromiter((x for s in sets for x in s), np.uint64)
            offsets = np.concatenate(([0], np.cumsum(sizes[keep])[:-1]))
            least = np.stack([np.minimum.reduceat(_mixed(flat, salt), offsets) for salt in salts], axis=1)
            keys = np.zeros((len(keep), bands), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(rows):
                    keys = keys * np.uint64(0x9E3779B97F4A7C15) + least[:, r::rows]
                keys ^= np.arange(bands, dtype=np.uint64) << np.uint64(56)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(keep)),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    pa.array([sets[i] for i in keep], pa.list_(pa.int64())),
                ],
                ["id", "bands", "shingles"],
            )

    return run


def links(texts: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """``a, b`` of verified pairs, by which every two texts of the similarity are joined, directly or over others.

    texts: ``id, text``, each text once; null and wordless texts have no links.
    """
    signed = durable(texts.filter("text is not null").select("id", "text").mapInArrow(_bands(bands, rows, words), "id long, bands array<long>, shingles array<long>"))
    rest = signed.select("id", F.explode("bands").alias("band"))
    ends = durable(rest.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high"))
    met = joined(rest, ends, "band").select("id", F.explode(F.array("low", "high")).alias("end")).filter("id <> end")
    found = durable(_verified(met.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct(), signed, similarity))
    return durable(found.unionByName(_verified(_across(signed, components(found), similarity), signed, similarity)))


def _prefixes(signed: DataFrame, similarity: float) -> DataFrame:
    """``id, size, token, place`` of what each set has among its first n - ceil(s n) + 1, the rarest first, and shares with others."""
    each = signed.select("id", F.explode("shingles").alias("token"))
    often = durable(each.groupBy("token").agg(F.count("*").alias("texts")).filter("texts > 1"))
    shared = joined(each, often, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("shared"))
    own = F.col("size") - F.size("shared")  # those of no other text come first, and nobody meets by them
    placed = signed.select("id", F.size("shingles").alias("size")).join(shared, "id").select("id", "size", own.alias("own"), F.posexplode("shared").alias("at", "t"))
    place = F.col("own") + F.col("at")
    return placed.select("id", "size", "t.token", place.alias("place")).filter(F.col("place") <= F.col("size") - F.ceil(similarity * F.col("size") - SLACK))


def _across(signed: DataFrame, kin: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of all pairs in different components (``kin``: ``id, component``) that may have the similarity."""
    members = _prefixes(signed, similarity).join(kin, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = durable(members)
    main = members.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"))
    groups = durable(main.select("token", "all", (F.col("all") - F.col("main.n")).alias("others"), F.col("main.component").alias("main")).filter("others > 0"))
    met = joined(members, groups, "token")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK)
    block = lambda c: F.pmod(F.xxhash64("id"), blocks(c))
    copies = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), blocks(c) - 1))
    side = lambda df, i, j: df.select("token", "id", "size", "place", "component", "main", i.alias("i"), j.alias("j"))
    x = side(met.filter("component <> main"), block("others"), copies("all")).alias("x")
    y = side(met, copies("others"), block("all")).alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    least, most = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    after = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    possible = (least >= similarity * most - SLACK) & (F.least("x.place", "y.place") + after >= similarity / (1 + similarity) * (least + most) - SLACK)
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("token", "i", "j")]
    pairs = x.join(y, [*same, F.col("x.component") != F.col("y.component"), once, possible])
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _verified(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    pairs = durable(pairs)
    sets = narrowed(signed.select("id", "shingles"), durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id")
    side = lambda c, name: sets.select(F.col("id").alias(c), F.col("shingles").alias(name))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(side("a", "x"), "a")
        .join(side("b", "y"), "b")
        .filter(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9)
        .select("a", "b")
    )


def clusters(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``id, cluster`` of the texts that are linked to another one."""
    return components(links(texts, similarity)).withColumnRenamed("component", "cluster")
