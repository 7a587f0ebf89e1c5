"""Scorers by name: functions of columns, or of batches of Python values where columns can't express them."""

from __future__ import annotations

import asyncio
import importlib.util
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN_SCORERS: dict[str, Callable[..., Column]] = {}
BATCH_SCORERS: dict[str, Callable[..., list]] = {}


def column_scorer(name: str):
    """Registers ``f(*columns) -> Column``; it stays within the JVM."""

    def add(f):
        COLUMN_SCORERS[name] = f
        return f

    return add


def batch_scorer(name: str):
    """Registers ``f(*lists) -> list of numbers``, called once a batch; None means not applicable."""

    def add(f):
        BATCH_SCORERS[name] = f
        return f

    return add


def async_scorer(name: str, at_once: int = 64):
    """Registers ``async f(*values) -> number``, a row a call; up to ``at_once`` calls of a batch wait at the same time."""

    def add(f):
        async def gathered(rows):
            gate = asyncio.Semaphore(at_once)

            async def one(row):
                async with gate:
                    return await f(*row)

            return await asyncio.gather(*map(one, rows))  # in the order of the rows, whichever ends first

        BATCH_SCORERS[name] = lambda *lists: asyncio.run(gathered(list(zip(*lists))))
        return f

    return add


def score(df: DataFrame, name: str, columns: list[str], out: str = "score") -> DataFrame:
    """``df`` with the scorer's column; an unknown name is an error, a scorer that returns another length, too."""
    if name in COLUMN_SCORERS:
        return df.withColumn(out, COLUMN_SCORERS[name](*map(F.col, columns)).cast("double"))
    f = BATCH_SCORERS[name]

    def run(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in frames:
            parts = (parts,) if isinstance(parts, pd.Series) else parts
            got = f(*(p.astype(object).where(p.notna(), None).tolist() for p in parts))
            if len(got) != len(parts[0]):
                raise ValueError(f"{name} gave {len(got)} scores for {len(parts[0])} rows")
            yield pd.Series([None if x is None else float(x) for x in got], dtype="float64")

    run.__annotations__ = {"frames": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "double")(*columns))


def load(path: str) -> None:
    """Runs a plug-in file, which registers its scorers."""
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    spec.loader.exec_module(importlib.util.module_from_spec(spec))
