"""Records of evaluation splits that are in the training split too, by clip name or by content.

Names are brought to a key: location, file ending, link additions, case and number padding are taken off, and marks of
copying, re-encoding or revision where they stand as such, at the end of the name or, of copies, before it. Keys are joined
within a few edits by segments, numbers being the block; the exact test that follows keeps pairs that differ in separators
only (``pet_cam 5``, ``petcam5``). Content is the sequence of a record's words, a symbol a word, joined by segments within
the words that may differ; emotions and times have to agree.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.embedded_json import find_value
from segloom.functions.spelling import fold
from segloom.llm.segment_join import segment_join
from segloom.operators.components import components
from segloom.session import durable, joined, narrowed

# File endings, and words that mark a copy, a re-encoding or a revision.
ENDINGS = "mp4 m4v avi mov mkv webm wmv flv mpg mpeg ts mts m2ts ogv ogg 3gp 3g2 vob asf f4v rm rmvb mxf gif".split()
MARKS = (
    "copy copyof dup duplicate backup bak final reenc reencode reencoded recode recoded transcode transcoded remux hd uhd fhd sd hq "
    "lq 4k 8k hevc avc edit edited rev revised version export exported converted compressed orig original new old tmp proxy fixed"
).split()
_MARK = re.compile(rf"(?:(?:{'|'.join(MARKS)})\d{{0,3}}|v\d{{1,3}}|r\d{{1,2}}|\d{{3,4}}[pi]|[xh]\.?26[345])$")
_ENDING = re.compile(rf"\.(?:{'|'.join(ENDINGS)})$")
_COUNT = re.compile(r"\s*[(\[]\d{1,3}[)\]]")
_LEADING = re.compile(r"^(?:copy[\W_]+(?:\(\d+\)[\W_]+)?of[\W_]+|re[\W_]+|dup[\W_]+|fwd?[\W_]+)+(?=\w)")
_PARTS = re.compile(r"[^\W_]+")
_PADDED = re.compile(r"([a-z]{2,})(\d{3,})$")
_PIECE = re.compile(r"pt0*(\d+)$")
#: Separators by which the keys of one clip may differ.
SEPARATORS = 3


def clip_key(name: str | None) -> str | None:
    """The name of a clip without all that doesn't tell clips apart, its words parted by spaces; None for null and for names
    without any letter or digit.

    Numbered parts (``_ptN``) stay. A mark counts at the end of the name, and a mark of copies before it; within a name it
    is a word like others (``old_man_01``). A name made of marks only keeps the first.
    """
    if name is None:
        return None
    s = name
    for _ in range(2):
        if "%" not in s:
            break
        s = unquote(s)
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    s = re.split(r"[?#]", s, maxsplit=1)[0].strip().rstrip("/\\")
    s = re.split(r"[/\\]", s)[-1].strip().lower()
    while True:
        shorter = _ENDING.sub("", s)
        if shorter == s or not shorter:
            break
        s = shorter
    s = _LEADING.sub("", _COUNT.sub("", s))
    kept = _PARTS.findall(s)
    part = []
    while len(kept) > 1 and (_MARK.match(kept[-1]) or _PIECE.match(kept[-1])):
        part = part or ([kept[-1]] if _PIECE.match(kept[-1]) else [])
        kept.pop()
    kept += part
    out = []
    for p in kept:
        if p.isdigit():
            out.append(p.lstrip("0") or "0")
        elif m := _PIECE.match(p):
            out.append(f"pt{m[1]}")
        elif m := _PADDED.match(p):
            out += [m[1], m[2].lstrip("0") or "0"]
        else:
            out.append(p)
    return " ".join(out) or None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [clip_key(x) for x in batch.column(1).to_pylist()]
        numbers = [None if k is None else " ".join(re.findall(r"\d+", k)) for k in keys]
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.string()), pa.array(numbers, pa.string())], ["row_id", "key", "numbers"])


def clip_keys(rows: DataFrame, name: str, key: str = "row_id") -> DataFrame:
    """``row_id, key, numbers``, once per id."""
    return (
        rows.filter(F.col(name).isNotNull())
        .select(F.col(key).alias("row_id"), F.col(name).alias("name"))
        .mapInArrow(_keys, "row_id long, key string, numbers string")
        .filter("key is not null")
        .distinct()
    )


def near_names(training: DataFrame, evaluation: DataFrame, edits: int = SEPARATORS) -> DataFrame:
    """``query, base, distance`` of the distinct keys of both sides within ``edits``.

    Keys whose numbers differ name different clips whatever else agrees, so the numbers are the block of the join.
    """
    side = lambda df: df.select(F.col("numbers").alias("block"), F.col("key").alias("id"), F.col("key").alias("text")).distinct()
    pairs = segment_join(side(evaluation), side(training), edits=edits)
    return pairs.withColumnsRenamed({"query_id": "query", "base_id": "base"})


def linked_names(training: DataFrame, evaluation: DataFrame, edits: int = SEPARATORS) -> DataFrame:
    """``query, base`` of the near keys that name one clip: they differ in separators only."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    return near_names(training, evaluation, edits).filter(bare("query") == bare("base")).select("query", "base")


def same_name(training: DataFrame, evaluation: DataFrame, edits: int = SEPARATORS) -> DataFrame:
    """``train_row_id, eval_row_id`` of the records of one clip: near names, then the exact test."""
    same = durable(linked_names(training, evaluation, edits))
    t = training.select(F.col("key").alias("base"), F.col("row_id").alias("train_row_id"))
    e = evaluation.select(F.col("key").alias("query"), F.col("row_id").alias("eval_row_id"))
    return joined(t, same, "base").join(e, "query").select("train_row_id", "eval_row_id").distinct()


def segment_list(value) -> list | None:
    """The list of segments of a JSON value: bare, under ``segments``, or one object deeper."""
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        for inner in (value, *(v for v in value.values() if isinstance(v, dict))):
            if isinstance(inner.get("segments"), list):
                return inner["segments"]
    return None


_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|\w+")
_CONTENT = "row_id long, sig binary, shape string, last_ds long, words string, times array<long>"


def _time(segment: dict, *names: str) -> int | None:
    for n in names:
        if n in segment:
            try:
                x = float(segment[n])
                return round(x * 1000) if abs(x) < 1e12 else None
            except (TypeError, ValueError):
                return None
    return None


class _Symbols(dict):
    """A code point beyond the basic plane for each word."""

    def __missing__(self, word: str) -> str:
        symbol = chr(0x10000 + zlib.crc32(word.encode()) % 0xF0000)
        if len(self) < 500_000:
            self[word] = symbol
        return symbol


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbols = _Symbols()
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            segments = segment_list(find_value(text))
            if not segments or len(segments) < 2 or not all(isinstance(s, dict) for s in segments):
                continue
            shape = "|".join(fold(str(s.get("emotion") or "")) for s in segments)
            times = [t for s in segments for t in (_time(s, "start_time", "start"), _time(s, "end_time", "end"))]
            reasons = [_WORD.findall(str(s.get("reason") or "").lower()) for s in segments]
            if not any(reasons):
                continue
            words = "\n".join("".join([symbols[w] for w in r]) for r in reasons)
            last = next((t for t in reversed(times) if t is not None), None)
            sig = hashlib.blake2b(f"{shape}\t{times}\t{words}".encode(), digest_size=16).digest()
            for column, x in zip(out, (row_id, sig, shape, -1 if last is None else last // 100, words, times)):
                column.append(x)
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], ["row_id", "sig", "shape", "last_ds", "words", "times"])


def contents(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """``row_id, sig, shape, last_ds, words, times`` of each list of two or more segments that an answer holds."""
    return (
        rows.select(F.col(key).alias("row_id"), F.explode("conversations").alias("t"))
        .filter((F.col("t.from") == "gpt") & F.col("t.value").rlike(r"[\[{]"))
        .select("row_id", F.col("t.value").alias("text"))
        .mapInArrow(_content, _CONTENT)
    )


def linked_contents(training: DataFrame, evaluation: DataFrame, words: float = 0.8, within_ms: int = 100) -> DataFrame:
    """``query_id, base_id``: the signatures of contents with one sequence of emotions, times and (nearly) words.

    training, evaluation: as ``contents`` gives them. A time that is missing agrees with a missing one only.
    """
    steps = within_ms // 100
    block = lambda ds: F.concat_ws(":", ds.cast("string"), F.col("shape"))
    q = evaluation.withColumn("ds", F.explode(F.array(*(F.col("last_ds") + d for d in range(-steps, steps + 1)))))
    q = q.select(block(F.col("ds")).alias("block"), F.col("sig").alias("id"), F.col("words").alias("text"))
    b = training.select(block(F.col("last_ds")).alias("block"), F.col("sig").alias("id"), F.col("words").alias("text"))
    # d <= (1 - words) * longer side follows from d <= (1 / words - 1) * query length.
    pairs = durable(segment_join(q, b, share=round(1 / words - 1, 6)))
    hit = lambda df, side: narrowed(df, durable(pairs.select(F.col(side).alias("sig")).distinct()), "sig")
    evaluation, training = hit(evaluation, "query_id"), hit(training, "base_id")
    e = evaluation.select(F.col("sig").alias("query_id"), F.col("times").alias("qt"), F.char_length("words").alias("qn")).distinct()
    t = training.select(F.col("sig").alias("base_id"), F.col("times").alias("bt"), F.char_length("words").alias("bn")).distinct()
    longer = F.greatest("qn", "bn")
    agree = F.forall(
        F.zip_with("qt", "bt", lambda x, y: F.coalesce(F.abs(x - y) <= within_ms + 1, x.isNull() & y.isNull())), lambda x: x
    )
    return (
        pairs.join(e, "query_id")
        .join(t, "base_id")
        .filter((F.col("distance") <= (1 - words) * longer + 1e-9) & (F.size("qt") == F.size("bt")) & agree)
        .select("query_id", "base_id")
    )


def same_content(training: DataFrame, evaluation: DataFrame, words: float = 0.8, within_ms: int = 100) -> DataFrame:
    """``train_row_id, eval_row_id`` of records of linked contents. Copies are joined once, by their signature."""
    same = durable(linked_contents(training, evaluation, words, within_ms))
    ids = lambda df, sig, name: narrowed(df, durable(same.select(F.col(sig).alias("sig")).distinct()), "sig").select(F.col("sig").alias(sig), F.col("row_id").alias(name)).distinct()
    return (
        same.join(ids(training, "base_id", "train_row_id"), "base_id")
        .join(ids(evaluation, "query_id", "eval_row_id"), "query_id")
        .select("train_row_id", "eval_row_id")
        .distinct()
    )


def clips(train_keys: DataFrame, eval_keys: DataFrame, train_contents: DataFrame, eval_contents: DataFrame) -> DataFrame:
    """``side, row_id, class_id, name_links, content_links``: each record that is in both splits, once.

    A class holds the records that links of names or contents join, directly or over others; links are the records of the
    other side. Keys and signatures are linked, never rows, so copies of a clip cost a row each and not a row a pair.
    """
    named = durable(linked_names(train_keys, eval_keys))
    alike = durable(linked_contents(train_contents, eval_contents))
    edges, counts = [], []
    for same, one, two, column, kind in ((named, eval_keys, train_keys, "key", "name"), (alike, eval_contents, train_contents, "sig", "content")):
        q, b = ("query", "base") if kind == "name" else ("query_id", "base_id")
        node = lambda side, c, kind=kind: F.xxhash64(F.lit(f"{kind} {side}"), F.col(c))
        edges.append(same.select(node("eval", q).alias("a"), node("train", b).alias("b")))
        for side, rows, mine, theirs, others in (("eval", one, q, b, two), ("train", two, b, q, one)):
            ids = rows.select(F.col(column).alias(mine), "row_id").distinct()
            held = others.select(F.col(column).alias(theirs), "row_id").distinct().groupBy(theirs).agg(F.count("*").alias("n"))
            links = same.join(held, theirs).groupBy(mine).agg(F.sum("n").alias("n"))
            hit = ids.join(links, mine)
            edges.append(hit.select(node(side, mine).alias("a"), F.xxhash64(F.lit(f"row {side}"), "row_id").alias("b")))
            counts.append(hit.select(F.lit(side).alias("side"), "row_id", F.lit(kind).alias("kind"), "n"))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    member = components(union(edges))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"{kind}_links")
    rows = union(counts).groupBy("side", "row_id").agg(of("name"), of("content"))
    return rows.withColumn("id", F.xxhash64(F.concat(F.lit("row "), "side"), "row_id")).join(member, "id").select("side", "row_id", F.col("component").alias("class_id"), "name_links", "content_links")
