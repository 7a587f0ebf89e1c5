"""Texts cut off by field limits or in transfer.

Storage counts a text in its own way, so its length is recomputed as code points, UTF-16 units, UTF-8 bytes, and with
entities or JSON escaped or with two-byte line ends; the tokens that were generated are one more length, if known. Grouped
by source and each of these, a hidden limit is a length at which texts pile up against its neighbourhood and break off.
Then endings are inspected. A text that ends inside a JSON value or with a mark is cut. Where no final punctuation stands,
a limit of the source decides first: at one, any open ending is a cut. Elsewhere the text itself has to tell: it is cut if
its run was stopped, or if it punctuates otherwise (``endings.punctuates``) and ends without. Nothing that a text of another
source does changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm import endings

VARIANTS = ("points", "utf16", "bytes", "entities", "entity_bytes", "json", "json_bytes", "crlf", "crlf_bytes", "tokens")
_READ = "id long, source string, stopped boolean, ending int, bare boolean, is_json boolean, punctuates boolean, lengths array<int>"
#: A limit: so many texts, so many times the mean of the lengths within so many units, so large a share broken off.
LEAST, TIMES, AROUND, BROKEN, SHORTEST = 5, 4.0, 10, 0.5, 64
def lengths(text: str) -> list[int]:
    """The length under each of VARIANTS but the tokens."""
    n = len(text)
    size = n if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
    astral = 0 if size == n else len(text.encode("utf-16-le", "surrogatepass")) // 2 - n
    count = text.count
    entities = 4 * count("&") + 3 * (count("<") + count(">")) + 5 * count('"') + 5 * count("'")
    short = count('"') + count("\\") + count("\n") + count("\r") + count("\t")
    wide = 0 if size == n else 5 * (n - len(text.encode("ascii", "ignore")) - astral) + 11 * astral
    crlf = count("\n") - count("\r\n")
    return [n, n + astral, size, n + entities, size + entities, n + short + wide, size + short, n + crlf, size + crlf]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()))
    for batch in batches:
        found = []
        for text, tokens in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            sizes = [*lengths(text), -1 if tokens is None else tokens]
            if endings.blank(text):
                found.append((endings.WHOLE, False, False, False, sizes))
            else:
                r = endings.read(text)
                opened = r.ending == endings.OPEN
                found.append((r.ending, not r.json and endings.bare(text), r.json, opened and endings.punctuates(text), sizes))
        columns = list(zip(*found)) or [()] * len(kinds)
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2)] + [pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _READ.split(", ")])


def readings(texts: DataFrame) -> DataFrame:
    """``id, source, stopped, ending, bare, is_json, punctuates, lengths`` once per id.

    texts: ``id, source, stopped, text`` and, if known, ``tokens``; null texts are left out (they have no end).
    """
    tokens = F.col("tokens").cast("int") if "tokens" in texts.columns else F.lit(None).cast("int")
    rows = texts.filter("id is not null and text is not null").select("id", "source", "stopped", "text", tokens.alias("tokens"))
    return rows.mapInArrow(_read, _READ).dropDuplicates(["id"])


def limits(read: DataFrame) -> DataFrame:
    """``source, variant, length, texts, broken``: lengths at which the texts of a source pile up and break off.

    Texts without a source are one source. Only counts per length are kept, so a large source costs no more than a small
    one after the first aggregation.
    """
    by = (
        read.select("source", (F.col("ending") > 0).alias("b"), F.posexplode("lengths").alias("v", "length"))
        .filter(F.col("length") >= SHORTEST)
        .groupBy("source", "v", "length")
        .agg(F.count("*").alias("texts"), F.sum(F.col("b").cast("int")).alias("broken"))
    )
    near = Window.partitionBy("source", "v").orderBy("length").rangeBetween(-AROUND, AROUND)
    return (
        by.withColumn("around", (F.sum("texts").over(near) - F.col("texts")) / (2 * AROUND))
        .filter((F.col("texts") >= LEAST) & (F.col("texts") >= TIMES * (1 + F.col("around"))) & (F.col("broken") >= BROKEN * F.col("texts")))
        .select("source", F.element_at(F.array(*map(F.lit, VARIANTS)), F.col("v") + 1).alias("variant"), "v", "length", "texts", "broken")
    )


def cut(read: DataFrame) -> DataFrame:
    """``id, source, ending, at_limit, rule`` of the cut texts; ``rule`` is what decides: ``json``, ``mark``, ``limit``, ``stopped`` or ``sentence``."""
    places = (
        limits(read)
        .groupBy("source")
        .agg(F.collect_set(F.struct("v", "length")).alias("limits"))  # a few lengths a source
        .withColumnRenamed("source", "s")
    )
    size = lambda x: F.element_at("lengths", x["v"] + 1)
    # A cut character or escape leaves up to three units less; tokens are whole.
    hit = lambda x: size(x).between(x["length"] - F.when(x["v"] == len(VARIANTS) - 1, 0).otherwise(3), x["length"])
    rule = (
        F.when((F.col("ending") == endings.CUT) & F.col("is_json"), "json")
        .when(F.col("ending") == endings.CUT, "mark")
        .when(F.col("at_limit"), "limit")
        .when(F.col("stopped"), "stopped")
        .when(F.col("punctuates"), "sentence")
    )
    return (
        read.filter("ending > 0 or bare")
        .join(places, F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("at_limit", F.coalesce(F.exists("limits", hit), F.lit(False)))
        .withColumn("rule", rule)
        .filter(F.col("rule").isNotNull() & ((F.col("ending") > 0) | (F.col("rule") == "limit")))
        .select("id", "source", "ending", "at_limit", "rule")
    )
