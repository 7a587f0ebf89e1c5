"""JSON and JSON Lines in and out: tolerant and strict scans, whole documents, dataset names, sinks, resuming."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segloom.functions.text import is_object


def read_tolerant(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines, lines that aren't JSON and values of other kinds are skipped. Adds ``_path``."""
    lines = spark.read.text(path).select(F.trim("value", F.lit(" \t\r")).alias("v"), F.col("_metadata.file_path").alias("_path")).filter("v <> ''")
    return lines.filter(is_object(F.col("v"))).select(F.from_json("v", schema).alias("r"), "_path").select("r.*", "_path")


def read_strict(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One object a line; any line that isn't fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_whole(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """``key, value`` of a file that is one object of objects."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "value"))


def read_list(spark: SparkSession, path: str, element: str = "string") -> DataFrame:
    """``value`` of a file that is one list; another value fails the job."""
    text = spark.read.text(path, wholetext=True)
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{element}>")).otherwise(F.raise_error(F.lit("not a list")).cast(f"array<{element}>"))
    return text.select(F.explode(rows).alias("value"))


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By ending: ``.jsonl``, ``.json`` (one document), ``.csv`` with a header, ``.parquet``, else a folder of parquet."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "jsonl":
        return reader.json(path)
    if ending == "json":
        return reader.option("multiLine", "true").json(path)
    if ending == "csv":
        return reader.option("header", "true").csv(path)
    return reader.parquet(path)


def read_tree(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """A row per JSON document anywhere below a folder, with its path."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.select("*", F.col("_metadata.file_path").alias("_path"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def latest(spark: SparkSession, paths: list[str], schema: T.StructType | str, key: str, filled: str) -> DataFrame:
    """Of several files in order the last row of each key whose ``filled`` member isn't empty, with its path."""
    from functools import reduce

    from segloom.operators.groups import last_per

    parts = [read_tolerant(spark, p, schema).withColumn("_order", F.lit(i)) for i, p in enumerate(paths)]
    rows = reduce(lambda a, b: a.unionByName(b), parts).filter(F.size(filled) > 0).withColumn("_line", F.monotonically_increasing_id())
    return last_per(rows, [key], ["_order", "_line"]).drop("_order", "_line")


@dataclass(frozen=True)
class DatasetName:
    """``path:subset/subset#count``; no subset means the default one, ``all`` every one; no count means all rows."""

    path: str
    subsets: tuple[str, ...] = ()
    count: int | None = None

    @staticmethod
    def parse(text: str) -> DatasetName:
        m = re.fullmatch(r"(?P<path>.+?)(?::(?P<subsets>[^:#/\\]+(?:/[^:#/\\]+)*))?(?:#(?P<count>\d+))?", text.strip())
        if not m or not m["path"]:
            raise ValueError(f"not a dataset name: {text!r}")
        return DatasetName(m["path"], tuple((m["subsets"] or "").split("/")) if m["subsets"] else (), int(m["count"]) if m["count"] else None)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines, null members kept; modes: append, overwrite, errorifexists (an exclusive creation)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """CSV of the given fields with a header; other columns are left out, absent ones are empty."""
    have = set(df.columns)
    df.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in fields)).write.mode(mode).option("header", "true").csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """Parquet in a folder for each split."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def write_with_metrics(details: DataFrame, metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Details as JSON Lines, and the metrics beside them under the name with ``_metrics``."""
    write_lines(details, path, mode)
    write_lines(metrics, re.sub(r"(\.jsonl)?$", "_metrics", path, count=1), mode)
