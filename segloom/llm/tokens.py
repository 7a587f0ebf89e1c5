"""Text sizes in tokens of a public tokenizer whose rank file is named by a path.

The driver gives the file to the application, so executors need no copy of their own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default rank file, and the pattern that its vocabulary presumes.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file, loaded once a worker."""
    if path not in _LOADED:
        import tiktoken

        local = path
        if not os.path.exists(path):
            from pyspark import SparkFiles

            local = SparkFiles.get(os.path.basename(path))
        with open(local, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def ranks_path(spark: SparkSession) -> str:
    """The rank file that the session names in ``spark.segloom.ranks``, else the default."""
    return spark.conf.get("spark.segloom.ranks", RANKS)


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def sizes(documents: DataFrame, path: str, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id, source, tokens``, once per id; whole texts count, null texts and ids are left out, an empty text has 0."""
    spark = documents.sparkSession
    if os.path.exists(path) and not spark.sparkContext.master.startswith("local"):
        spark.sparkContext.addFile(path)
    return (
        documents.filter(F.col(text).isNotNull() & F.col(key).isNotNull())
        .select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
        .mapInArrow(_sizes(path), "doc_id long, source string, tokens long")
        .dropDuplicates(["doc_id"])
    )
