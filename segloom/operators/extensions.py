"""Places for code of the user's own: metrics with a state, environments that rows are played in, rows that make rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.session import ship


class Metric(Protocol):
    """A metric keeps a state that is small whatever was added to it; states of parts of the data are merged in any order."""

    def reset(self) -> None: ...

    def update(self, rows: pd.DataFrame) -> None: ...

    def merge(self, other: Metric) -> None: ...

    def compute(self) -> dict[str, float]: ...


class Mean:
    """Mean and number of a column's values, nulls left out."""

    def __init__(self, column: str):
        self.column = column
        self.reset()

    def reset(self) -> None:
        self.total, self.n = 0.0, 0

    def update(self, rows: pd.DataFrame) -> None:
        x = rows[self.column].dropna()
        self.total, self.n = self.total + float(x.sum()), self.n + len(x)

    def merge(self, other: Mean) -> None:
        self.total, self.n = self.total + other.total, self.n + other.n

    def compute(self) -> dict[str, float]:
        return {"mean": self.total / self.n if self.n else 0.0, "n": float(self.n)}


def evaluated(df: DataFrame, make: Callable[[], Metric], columns: list[str], fan: int = 64) -> DataFrame:
    """``name, value`` of a metric over all rows: a state a task, merged by groups of ``fan`` and then all; none without rows."""
    ship(df.sparkSession)

    def states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        metric, seen = make(), False
        for f in frames:
            if len(f):
                metric.update(f)
                seen = True
        if seen:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "state": [pickle.dumps(metric)]})

    def joined(rows) -> Any:
        metric = make()
        for s in rows:
            metric.merge(pickle.loads(s))
        return metric

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [0], "state": [pickle.dumps(joined(f.sort_values("at")["state"]))]})

    def final(f: pd.DataFrame) -> pd.DataFrame:
        values = joined(f["state"]).compute()
        return pd.DataFrame({"name": list(values), "value": [float(v) for v in values.values()]})

    kind = "at int, state binary"
    parts = df.select(*columns).mapInPandas(states, kind)
    level = parts.withColumn("g", (F.col("at") / fan).cast("int")).groupBy("g").applyInPandas(merged, kind)
    return level.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(final, "name string, value double")


class Environment(Protocol):
    """What rows are played in: ``reset`` gives the first observation, ``step`` the next one, a reward and whether it is over."""

    def reset(self, row: dict) -> Any: ...

    def step(self, action: Any) -> tuple[Any, float, bool]: ...

    def close(self) -> None: ...


def played(df: DataFrame, key: str, make: Callable[[], Environment], act: Callable[[Any, list], Any], most_steps: int) -> DataFrame:
    """``key, step, action, observation, reward, done`` of every row played to its end, at most ``most_steps`` steps.

    A task makes one environment, resets it for each row and closes it at the end, also after an error.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        world = make()
        try:
            for f in frames:
                out = []
                for row in f.to_dict("records"):
                    seen, past = world.reset(row), []
                    for n in range(most_steps):
                        action = act(seen, past)
                        seen, reward, done = world.step(action)
                        past.append((action, seen))
                        out.append((row[key], n, str(action), str(seen), float(reward), bool(done)))
                        if done:
                            break
                yield pd.DataFrame(out, columns=["key", "step", "action", "observation", "reward", "done"])
        finally:
            world.close()

    return df.mapInPandas(run, f"key {kind}, step int, action string, observation string, reward double, done boolean").withColumnRenamed("key", key)


def grown(df: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """Any number of rows from each row, as ``make`` yields them."""
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(",")]
        for f in frames:
            rows = [r for row in f.to_dict("records") for r in make(row)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)
