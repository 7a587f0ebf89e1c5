"""All problem queries on changed copies of the small tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.queries() if n[0] == "p" and n[1].isdigit())
TABLES = ("train", "test", "manifest", "segments", "outputs", "documents", "emotion_vocab", "pack_capacity", "mix_targets")
CLASH = ("entity", "id", "label", "part", "form", "block", "text_", "k", "tokens", "doc", "open", "key", "first", "edge", "ending", "opening", "position")


@pytest.fixture(scope="module")
def folders(spark, small, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    for t in TABLES:
        df = spark.read.parquet(f"{small}/{t}.parquet")
        df.limit(0).write.parquet(f"{base}/empty/{t}.parquet")
        nothing = df.limit(1).select(*(F.lit(None).cast(c.dataType).alias(c.name) for c in df.schema))
        fixed = t in ("emotion_vocab", "pack_capacity", "mix_targets")
        (df if fixed else df.union(nothing).union(nothing)).write.parquet(f"{base}/nulls/{t}.parquet")
        df.union(df).select("*", *(F.lit("clash").alias(c) for c in CLASH if c not in df.columns)).write.parquet(f"{base}/clash/{t}.parquet")
    return base


def rows(spark, name, folder):
    df = entry.queries()[name](spark, str(folder))
    return sorted(repr(r) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, folders, name):
    assert len(rows(spark, name, folders / "empty")) == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n.endswith("_found")])
def test_rows_of_nulls_and_repeated_rows_with_more_columns(spark, small, folders, name):
    want = rows(spark, name, small)
    assert rows(spark, name, folders / "clash") == want
    assert rows(spark, name, folders / "nulls") == want


@pytest.mark.parametrize("name", [n for n in NAMES if not n.endswith("_found")])
def test_others_run_on_rows_of_nulls(spark, folders, name):
    rows(spark, name, folders / "nulls")
