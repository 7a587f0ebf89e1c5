"""Operators on the ordered, labelled segments of each entity.

Two shapes are used. Exploded rows ``entity, idx, s, e, label`` go through ``ordered.scan``, which splits any entity over
tasks. Segment lists (an array of structs per record) are folded in place by higher-order functions; they suit records
whose own list is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import intervals as iv
from segloom.operators.ordered import scan

SEGMENT = "struct<start_time:double,end_time:double,emotion:string,reason:string>"


def numbered(rows: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """``idx``, the place of each row within its entity from 0."""
    return scan(rows.withColumn("one", F.lit(1)), entity, keys, sums=["one"]).withColumn("idx", F.col("run_one") - 1).drop("one", "run_one")


def islands(rows: DataFrame, entity: str, keys: list[str], label: str) -> DataFrame:
    """Runs of rows with one label: ``entity, island, label, first key, last key, n, s, e``. Null labels are a label of their own."""
    flagged = scan(rows, entity, keys, lags=[label, "one"]).withColumn(
        "change", F.when(F.col("prev_one").isNotNull() & F.col(label).eqNullSafe(F.col(f"prev_{label}")), 0).otherwise(1)
    )
    cut = scan(flagged.drop(f"prev_{label}", "prev_one"), entity, keys, sums=["change"])
    return cut.groupBy(entity, F.col("run_change").alias("island")).agg(
        F.first(label).alias(label), F.count("*").alias("n"), F.min("s").alias("s"), F.max("e").alias("e"), F.min(keys[-1]).alias("first_id")
    )


def tile(segments: Column, duration: Column, least: float = 0.1) -> Column:
    """A gap-free tiling of [0, duration] out of a segment list: clamped, sorted, each start at the end before.

    Segments without two numbers or with an end not above the start are dropped, NaN ones too. Every later segment keeps room for
    ``least`` seconds; the last ends at the duration. No usable segment gives one over all; a duration not above 0 none.
    """
    good = F.filter(
        segments,
        lambda x: x["start_time"].isNotNull() & x["end_time"].isNotNull() & ~F.isnan(x["start_time"]) & ~F.isnan(x["end_time"]) & (x["end_time"] > x["start_time"]),
    )
    inside = F.transform(
        good,
        lambda x: F.struct(
            F.least(F.greatest(x["start_time"], F.lit(0.0)), duration).alias("start_time"),
            F.least(F.greatest(x["end_time"], F.lit(0.0)), duration).alias("end_time"),
            x["emotion"].alias("emotion"),
            x["reason"].alias("reason"),
        ),
    )
    kept = F.array_sort(F.filter(inside, lambda x: x["end_time"] > x["start_time"]))
    empty = F.array().cast(f"array<{SEGMENT}>")
    whole = F.array(F.struct(F.lit(0.0).alias("start_time"), duration.alias("end_time"), F.lit(None).cast("string").alias("emotion"), F.lit(None).cast("string").alias("reason"))).cast(f"array<{SEGMENT}>")

    def step(acc: Column, x: Column) -> Column:
        n = F.size(kept)
        at = F.size(acc["out"])
        start = acc["at"]
        room = iv.one_decimal(duration - (n - at - 1) * least)
        end = F.when(at == n - 1, duration).otherwise(F.least(F.greatest(iv.one_decimal(x["end_time"]), iv.one_decimal(start + least)), room))
        piece = F.struct(start.alias("start_time"), end.alias("end_time"), x["emotion"].alias("emotion"), x["reason"].alias("reason"))
        return F.struct(F.concat(acc["out"], F.array(piece)).alias("out"), end.alias("at"))

    fold = F.aggregate(kept, F.struct(empty.alias("out"), F.lit(0.0).alias("at")), step, lambda acc: acc["out"])
    return F.when(F.coalesce(duration, F.lit(0.0)) <= 0, empty).when(F.size(kept) <= 0, whole).otherwise(fold)


def merge_equal(segments: Column) -> Column:
    """Neighbours of one label become one: the last end counts, a reason is added with a space unless the text so far has it."""
    empty = F.array().cast(f"array<{SEGMENT}>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        had, new = F.coalesce(last["reason"], F.lit("")), F.coalesce(x["reason"], F.lit(""))
        text = F.when((new == "") | F.contains(had, new), had).when(had == "", new).otherwise(F.concat_ws(" ", had, new))
        joined = F.struct(last["start_time"].alias("start_time"), x["end_time"].alias("end_time"), last["emotion"].alias("emotion"), text.alias("reason"))
        same = (F.size(acc) > 0) & last["emotion"].eqNullSafe(x["emotion"])
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(segments, empty, step)


def repair_label(label: Column, vocabulary: list[str], default: str = "Interest") -> Column:
    """The label itself if known; else the first entry that contains it or that it contains, case aside; else the default.

    An empty label is contained in the first entry. Null counts as empty.
    """
    low = F.lower(F.coalesce(label, F.lit("")))
    words = F.array(*map(F.lit, vocabulary))
    near = F.filter(words, lambda v: F.contains(F.lower(v), low) | F.contains(low, F.lower(v)))
    return F.when(label.isin(vocabulary), label).otherwise(F.coalesce(F.get(near, 0), F.lit(default)))


def close_gaps(segments: Column, duration: Column, tolerance: float = 0.5) -> Column:
    """First start 0; starts moved to the end before; the last end set to the duration if it is off by more than the tolerance."""
    n = F.size(segments)

    def fix(x: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0.0)).otherwise(F.get(segments, i - 1)["end_time"])
        end = F.when((i == n - 1) & (F.abs(x["end_time"] - duration) > tolerance), duration).otherwise(x["end_time"])
        return F.struct(start.alias("start_time"), end.alias("end_time"), x["emotion"].alias("emotion"), x["reason"].alias("reason"))

    return F.transform(segments, fix)


def listing(segments: Column) -> Column:
    """A line a segment with its number, times and label, for prompts."""
    line = lambda x, i: F.concat(
        F.format_string("Segment %d: [%.1fs, %.1fs] ", i, F.round(x["start_time"], 1), F.round(x["end_time"], 1)), F.coalesce(x["emotion"], F.lit("none"))
    )
    return F.array_join(F.transform(segments, line), "\n")


def first_fault(segments: Column, duration: Column, vocabulary: list[str], tolerance: float, decimals: bool) -> Column:
    """The first rule that a segment list breaks, else null: empty, order, continuity, label, reason, repeated, decimals, coverage.

    Tolerance bounds the hole or overlap between neighbours, the first start and the end against the duration.
    """
    n = F.size(segments)
    pairs = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    here = lambda i: F.get(segments, i)
    rules = [
        (n <= 0, "empty"),
        (F.exists(segments, lambda x: F.coalesce(~(x["end_time"] > x["start_time"]), F.lit(True))), "order"),
        (F.exists(pairs, lambda i: F.abs(here(i)["start_time"] - here(i - 1)["end_time"]) > tolerance), "continuity"),
        (F.exists(segments, lambda x: ~F.coalesce(x["emotion"].isin(vocabulary), F.lit(False))), "label"),
        (F.exists(segments, lambda x: F.trim(F.coalesce(x["reason"], F.lit(""))) == ""), "reason"),
        (F.exists(pairs, lambda i: here(i)["emotion"] == here(i - 1)["emotion"]), "repeated"),
    ]
    if decimals:
        rules.append((F.exists(segments, lambda x: ~(iv.one_decimal_only(x["start_time"]) & iv.one_decimal_only(x["end_time"]))), "decimals"))
    rules.append(((F.abs(here(F.lit(0))["start_time"]) > tolerance) | (F.abs(here(n - 1)["end_time"] - duration) > tolerance), "coverage"))
    out = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(True)), name)
    return out


def snap(rows: DataFrame, cuts: DataFrame, window: int) -> DataFrame:
    """``entity, idx, t, aligned, delta`` of boundaries moved to the nearest cut within the window, the earlier one on a tie.

    rows: ``entity, idx, t``; cuts: ``entity, c``. Time is cut into buckets of the window's width, so a boundary meets the
    cuts of three buckets only, however many its entity has.
    """
    width = max(1, window)
    b = rows.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("t") / width) + d for d in (-1, 0, 1)))))
    c = cuts.select("entity", "c", F.floor(F.col("c") / width).alias("bucket")).distinct()
    near = b.join(c, ["entity", "bucket"]).filter(F.abs(F.col("c") - F.col("t")) <= window)
    best = near.groupBy("entity", "idx").agg(F.min(F.struct(F.abs(F.col("c") - F.col("t")).alias("d"), F.col("c").alias("c"))).alias("m"))
    return rows.join(best, ["entity", "idx"], "left").select(
        "entity", "idx", "t", F.coalesce(F.col("m.c"), F.col("t")).alias("aligned"), F.coalesce(F.col("m.c") - F.col("t"), F.lit(0)).alias("delta")
    )


def overlapping(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """All pairs of overlapping rows of one entity. a: ``entity, i, s, e``; b: ``entity, j, s2, e2``.

    Each row stands in every time bucket that it touches, and a pair is found in the first bucket common to both, so the
    join is an equi-join on (entity, bucket) and a hot entity is spread over its buckets.
    """
    spread = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    left = a.filter("e > s").withColumn("bucket", spread("s", "e"))
    right = b.filter("e2 > s2").withColumn("bucket", spread("s2", "e2"))
    met = left.join(right, ["entity", "bucket"]).filter((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")))
    return met.filter(F.col("bucket") == F.floor(F.greatest("s", "s2") / width)).drop("bucket")


def best_match(a: DataFrame, b: DataFrame, width: int, by: str = "iou") -> DataFrame:
    """Each row of a with its match: the row of b with the highest IoU (or common length), the first on a tie.

    Without any overlap it is the entity's first row of b; entities without rows of b give a null match. The result has
    the columns of a, those of the match, and ``iou, common``; further columns come along, so nothing has to be joined back.
    """
    met = overlapping(a, b, width)
    met = met.withColumn("iou", iv.iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).withColumn("common", iv.overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")))
    own = ["j", *(c for c in b.columns if c not in ("entity", "j"))]
    best = met.groupBy("entity", "i").agg(F.min(F.struct((-F.col(by)).alias("k"), *own, "iou", "common")).alias("m"))
    first = b.groupBy("entity").agg(F.min(F.struct(*own)).alias("f"))
    rows = a.join(best, ["entity", "i"], "left").join(first, "entity", "left")
    match = [F.when(F.col("m").isNotNull(), F.col(f"m.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in own]
    return rows.select(*a.columns, *match, F.coalesce("m.iou", F.lit(0.0)).alias("iou"), F.coalesce("m.common", F.lit(0)).alias("common"))


def matched(eligible: DataFrame) -> DataFrame:
    """``entity, pairs``: the size of a maximum one-to-one matching of the eligible pairs ``entity, i, j``.

    Only rows that share an eligible pair, directly or over others, can compete, so the matching is made per connected
    component of the entity's pairs, which time keeps small, and never for a whole entity.
    """
    from segloom.operators.components import components

    nodes = eligible.select("entity", "i", "j", F.xxhash64("entity", F.lit("i"), "i").alias("a"), F.xxhash64("entity", F.lit("j"), "j").alias("b"))
    part = components(nodes.select("a", "b")).withColumnRenamed("id", "a")
    rows = nodes.join(part, "a").select("entity", "component", "i", "j")
    sorted_ = rows.repartition("component").sortWithinPartitions("component", "i", "j")
    return sorted_.mapInArrow(_sizes, "entity string, pairs long").groupBy("entity").agg(F.sum("pairs").alias("pairs"))


def _sizes(batches):
    """The size of each component's matching; a task takes its components one after the other."""
    import pyarrow as pa

    at, entity, near, out = None, None, {}, []
    for batch in batches:
        for c, e, i, j in zip(*(batch.column(n).to_pylist() for n in ("component", "entity", "i", "j"))):
            if c != at:
                if near:
                    out.append((entity, _kuhn(near)))
                at, entity, near = c, e, {}
            near.setdefault(i, []).append(j)
        if len(out) > 10_000:
            yield pa.record_batch([pa.array(x) for x in zip(*out)], ["entity", "pairs"])
            out = []
    if near:
        out.append((entity, _kuhn(near)))
    if out:
        yield pa.record_batch([pa.array(x) for x in zip(*out)], ["entity", "pairs"])


def _kuhn(near: dict[int, list[int]]) -> int:
    taken: dict[int, int] = {}

    def place(i: int, seen: set) -> bool:
        # An explicit stack: chains of displaced rows may be long.
        stack = [(i, iter(sorted(near[i])))]
        path: list[tuple[int, int]] = []
        while stack:
            at, choices = stack[-1]
            for j in choices:
                if j in seen:
                    continue
                seen.add(j)
                if j not in taken:
                    for a, b in [*path, (at, j)]:
                        taken[b] = a
                    return True
                path.append((at, j))
                stack.append((taken[j], iter(sorted(near[taken[j]]))))
                break
            else:
                stack.pop()
                if path:
                    path.pop()
        return False

    return sum(place(i, set()) for i in sorted(near))
