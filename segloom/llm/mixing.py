"""Records of several sources mixed to target shares of all tokens, in the order of a time-varying curriculum.

A source of weight ``w`` and tilt ``a`` has the weight ``w (1 + a (2 t - 1))`` at time t of training; the tilts are
balanced, so the weights sum to 1 at any time, and over the whole time the source has its share. Its cumulative demand
is ``T w (t + a (t^2 - t))``; a record that stands at c tokens of its source's order is needed at the time where the
demand is c, found by solving the quadratic. The order within a source is by a hash of id and pass, its running sum is
made by ranges of that order: sums within a task, then one offset per task and source. The mix is range-sorted by time.
Records are used as long as they end within the demand; what then is missing, less than the next record, is filled by
records further on in the order, the largest that fits again and again until none does: their sizes are counted, and the
counts of the sizes that fit (fewer than the missing tokens) decide it in one step. They follow the others in the order,
so their time is that of the demand they fill, too.

The total T is the largest at which every source can have its share with no record used more than its source allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.operators.ordered import in_order
from segloom.session import durable, partitions

#: Targets beyond this number are an error.
MOST_SOURCES = 10_000
_SUMMED = "source string, pass int, doc_id long, tokens long, upto long, part int"


@dataclass(frozen=True)
class Plan:
    source: str
    share: float
    demand: float
    passes: int
    tilt: float


def tilts(shares: list[float], mean_sizes: list[float], strength: float) -> list[float]:
    """Early (below 0) for sources of short records, late for long ones; the share-weighted sum is 0, none exceeds 1."""
    n = len(shares)
    order = sorted(range(n), key=lambda i: mean_sizes[i])
    raw = [0.0] * n
    for rank, i in enumerate(order):
        raw[i] = strength * (2 * rank / (n - 1) - 1) if n > 1 else 0.0
    middle = sum(w * a for w, a in zip(shares, raw)) / (sum(shares) or 1.0)
    raw = [a - middle for a in raw]
    top = max([1.0, *map(abs, raw)])
    return [a / top for a in raw]


def plan(supply: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], total: int | None = None, strength: float = 0.5) -> list[Plan]:
    """What each source is to give. supply: tokens and records of a source; targets: source, share, most uses of a record.

    Shares are scaled to the sum 1. A target without supply, or of share 0, gets nothing, and the others keep the
    proportions between them. With a total above what a source can give, the source gives all it may.
    """
    live = [(s, w, r) for s, w, r in targets if w > 0 and r > 0 and supply.get(s, (0, 0))[0] > 0]
    weight = sum(w for _, w, _ in live)
    if not live:
        return []
    shares = [w / weight for _, w, _ in live]
    most = [supply[s][0] * r for s, _, r in live]
    size = min(m / w for m, w in zip(most, shares)) if total is None else total
    lean = tilts(shares, [supply[s][0] / supply[s][1] for s, _, _ in live], strength)
    out = []
    for (s, _, r), w, m, a in zip(live, shares, most, lean):
        demand = min(w * size, m)
        out.append(Plan(s, w, demand, min(r, math.ceil(demand / supply[s][0] - 1e-9)), a))
    return out


def time_of(u: np.ndarray, tilt: np.ndarray) -> np.ndarray:
    """Where the share u of a source's demand is reached: the root in [0, 1] of a t^2 + (1 - a) t = u."""
    flat = np.abs(tilt) < 1e-9
    a = np.where(flat, 1.0, tilt)
    root = (np.sqrt((1 - a) ** 2 + 4 * a * u) - (1 - a)) / (2 * a)
    return np.clip(np.where(flat, u, root), 0.0, 1.0)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, held = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = batch.column("source").dictionary_encode()
        codes = np.asarray(names.indices)
        total = np.cumsum(np.asarray(batch.column("tokens")))
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        before = np.concatenate(([0], total))[starts]
        before[0] -= held if names[0].as_py() == last else 0
        upto = total - np.repeat(before, np.diff(np.append(starts, n)))
        last, held = names[n - 1].as_py(), int(upto[-1])
        yield pa.record_batch(
            [*(batch.column(c) for c in ("source", "pass", "doc_id", "tokens")), pa.array(upto, pa.int64()), pa.array(np.full(n, part, np.int32))],
            ["source", "pass", "doc_id", "tokens", "upto", "part"],
        )


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, tilt = (np.asarray(batch.column(c)) for c in ("u", "tilt"))
        columns = [batch.column(c) for c in ("source", "doc_id", "pass", "tokens")]
        yield pa.record_batch([pa.array(time_of(u, tilt)), *columns], ["position", "source", "doc_id", "pass", "tokens"])


def supplies(sizes: DataFrame, targets: DataFrame) -> dict[str, tuple[int, int]]:
    """Tokens and records of each source with a target: at most a row a target."""
    rows = (
        sizes.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
        .groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    )
    return {r.source: (r.t, r.n) for r in rows}


def fill(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """``(size, records)`` that fill the room: the largest that fits, again and again. counts: records of each size."""
    out = []
    for size in sorted(counts, reverse=True):
        n = min(counts[size], room // size)
        if n:
            out.append((size, n))
            room -= n * size
    return out


def _fillers(located: DataFrame, plans: list[Plan]) -> DataFrame:
    """``source, doc_id, pass, tokens, end`` of the records that fill what those within the demand leave; see ``fill``."""
    spark = located.sparkSession
    reached = {r.source: r.n for r in located.filter("within").groupBy("source").agg(F.max("end").alias("n")).collect()}
    room = [(p.source, n) for p in plans if (n := int(p.demand - reached.get(p.source, 0))) > 0]
    rest = located.filter("not within and tokens > 0").join(F.broadcast(spark.createDataFrame(room, "source string, room long")), "source").filter("tokens <= room")
    counts: dict[str, dict[int, int]] = {}
    for r in rest.groupBy("source", "tokens").agg(F.count("*").alias("n")).collect():  # a row a size that fits
        counts.setdefault(r.source, {})[r.tokens] = r.n
    chosen = []
    for source, n in room:
        at = reached.get(source, 0)
        for size, records in fill(n, counts.get(source, {})):
            chosen.append((source, size, records, at))
            at += records * size
    picks = F.broadcast(spark.createDataFrame(chosen, "source string, tokens long, records long, at long"))
    most = max((c[2] for c in chosen), default=0)
    nth = F.row_number().over(Window.partitionBy("source", "tokens").orderBy("end"))
    few = located.filter("not within").join(picks, ["source", "tokens"]).withColumn("nth", nth).filter((F.col("nth") <= most) & (F.col("nth") <= F.col("records")))
    return few.select("source", "doc_id", "pass", "tokens", "demand", "tilt", (F.col("at") + F.col("nth") * F.col("tokens")).alias("end"))


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, strength: float = 0.5) -> DataFrame:
    """``position, source, doc_id, pass, tokens`` sorted by position, the time of training in [0, 1].

    sizes: ``doc_id, source, tokens``; targets: ``source, target_share, max_repeats``, a small table whose size is
    checked. Records of sources without a target (or of none) aren't used. A source stays below its demand by less than
    any of its records that are left.
    """
    wanted = targets.filter("source is not null").select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    spark = sizes.sparkSession
    plans = plan(supplies(sizes, targets), [(r.source, r.target_share or 0.0, r.max_repeats or 0) for r in wanted], total, strength)
    planned = spark.createDataFrame(
        [(p.source, p.demand, p.passes, p.tilt) for p in plans], "source string, demand double, passes int, tilt double"
    )
    rows = (
        sizes.join(F.broadcast(planned.select("source", "passes")), "source")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("h", F.xxhash64("doc_id", "pass"))
        .select("source", "pass", "h", "doc_id", "tokens")
    )
    summed = durable(in_order(rows, "source", "pass", "h", "doc_id").mapInArrow(_running, _SUMMED))
    # A row per task and source; a task holds a range of the order, so there are at most tasks plus sources of them.
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summed.groupBy("source", "part").agg(F.max("upto").alias("all")).select(
        "source", "part", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead")
    )
    located = (
        summed.join(F.broadcast(offsets), ["source", "part"])
        .join(F.broadcast(planned), "source")
        .withColumn("end", F.col("ahead") + F.col("upto"))
        .withColumn("within", F.col("end") <= F.col("demand"))
    )
    keep = ["source", "doc_id", "pass", "tokens", "demand", "tilt", "end"]
    used = located.filter("within").select(keep).unionByName(_fillers(located, plans).select(keep))
    return (
        used.withColumn("u", (F.col("end") - F.col("tokens") / 2) / F.col("demand"))
        .select("source", "doc_id", "pass", "tokens", "u", "tilt")
        .mapInArrow(_place, "position double, source string, doc_id long, pass int, tokens long")
        .repartitionByRange(partitions(spark), "position", "doc_id")
        .sortWithinPartitions("position", "doc_id", "pass")
    )


def violations(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``rule, cases``: how often the mix breaks a rule (each has to be 0); no rows for an empty mix."""
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("pass").alias("m"), F.max("tokens").alias("t"), F.min("tokens").alias("s"))
    known = sizes.select("doc_id", F.col("source").alias("own"), F.col("tokens").alias("size"))
    held = uses.join(known, "doc_id", "left").join(F.broadcast(targets.select("source", "max_repeats")), "source", "left")
    wrong = F.col("own").isNull() | (F.col("own") != F.col("source")) | (F.col("t") != F.col("size")) | (F.col("s") != F.col("size"))
    by = held.agg(
        F.count_if(wrong).alias("unlike its record"),
        F.count_if((F.col("n") > F.col("max_repeats")) | F.col("max_repeats").isNull()).alias("used too often"),
        F.count_if(F.col("n") != F.col("m")).alias("twice in a pass"),
        F.count("*").alias("all"),
    )
    off = shares(mixed, targets).agg(F.count_if((F.abs(F.col("reached_share") - F.col("target_share")) > 0.02) & (F.col("target_share") > 0)).alias("off its share"))
    out = mixed.agg(F.count_if(~F.col("position").between(0, 1)).alias("out of time"))
    row = by.crossJoin(off).crossJoin(out).filter("all > 0")  # one row each
    names = ["unlike its record", "used too often", "twice in a pass", "off its share", "out of time"]
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("cases")) for n in names))).alias("x")).select("x.rule", "x.cases")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, tokens, reached_share, records, most_uses`` of every source with a target."""
    uses = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    by = uses.groupBy("source").agg(F.sum("t").alias("tokens"), F.count("*").alias("records"), F.max("n").alias("most_uses"))
    everything = by.agg(F.sum("tokens").alias("everything"))
    return (
        targets.join(by, "source", "left")
        .join(F.broadcast(everything))
        .select(
            "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"),
            (F.coalesce("tokens", F.lit(0)) / F.col("everything")).alias("reached_share"),
            F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
        )
    )
