"""Bounded loops and ordered folds over the segment lists of records, with the scorer as a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.operators.segments import SEGMENT


def merge_rescored(segments: Column, rescore: Callable[[Column], Column], glue: str = " Then, ") -> Column:
    """A fold from the first segment on: a segment with the label of the one before is joined to it, the joined text gets a
    new label from ``rescore`` (a function of the text), and the result is the segment before for what follows.
    """
    empty = F.array().cast(f"array<{SEGMENT}>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        text = F.concat_ws(glue, last["reason"], x["reason"])
        joined = F.struct(last["start_time"].alias("start_time"), x["end_time"].alias("end_time"), rescore(text).alias("emotion"), text.alias("reason"))
        same = (F.size(acc) > 0) & (last["emotion"] == x["emotion"])
        return F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(segments, empty, step)


def until_complete(df: DataFrame, refine: Callable[[DataFrame], DataFrame], complete: Column, rounds: int) -> DataFrame:
    """Applies ``refine`` to the rows that aren't complete, at most ``rounds`` times; adds ``rounds``, the number applied.

    The plan has one branch a round and no action; rows that are complete at once go past all of them.
    """
    done, work = df.filter(complete).withColumn("rounds", F.lit(0)), df.filter(~F.coalesce(complete, F.lit(False))).withColumn("rounds", F.lit(0))
    for i in range(rounds):
        work = refine(work).withColumn("rounds", F.lit(i + 1))
        if i + 1 < rounds:
            done = done.unionByName(work.filter(complete))
            work = work.filter(~F.coalesce(complete, F.lit(False)))
    return done.unionByName(work)


def turns(df: DataFrame, step: Callable[[dict, int], tuple[dict, bool]], schema: str, most: int) -> DataFrame:
    """Runs a scheduler a row: ``step(row, turn)`` gives the new row and whether it is finished, for at most ``most`` turns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                for turn in range(most):
                    row, finished = step(row, turn)
                    if finished:
                        break
                out.append(row)
            yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in schema.split(",")])

    return df.mapInPandas(run, schema)
