"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of words and terms.
WORD = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"
TERM = r"[a-z][a-z\-]{2,}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Words, or half the characters of the trimmed text where it has none."""
    n = F.size(words(text))
    return F.when(n > 0, n).otherwise(F.floor(F.char_length(F.trim(text)) / 2).cast("int"))


def token_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def terms(text: Column, stopwords: list[str]) -> Column:
    """Lower-case terms of three characters or more, hyphens at the ends stripped, without stop words."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)), lambda w: F.trim(w, F.lit("-")))
    return F.filter(found, lambda w: (F.char_length(w) >= 3) & ~w.isin(stopwords))


def repetition(text: Column, n: int = 3) -> Column:
    """The share of repeated word n-grams, 0 for texts shorter than n words."""
    w = F.split(F.trim(F.lower(text)), r"\s+")
    total = F.size(w) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), total), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(total > 0, 1 - F.size(F.array_distinct(grams)) / total).otherwise(0.0)


def stem(path: Column) -> Column:
    """The file name without its last ending; backslashes count as slashes."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]+?)(\.[^./]*)?$", 1)


def occurrences(text: Column, token: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(token), F.lit("")))) / F.lit(len(token))


def without_fence(text: Column) -> Column:
    """The content of a text that begins with a fence of backticks, else the trimmed text."""
    t = F.trim(text, F.lit(" \n\r\t"))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(t, F.lit("```")), inner).otherwise(t)


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def _enclosed(text: Column) -> Column:
    """The values of a text in an array: the parser lets text after a value pass, but not within brackets."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def is_object(text: Column) -> Column:
    """Whether a text is one whole JSON object with nothing after it."""
    v = _enclosed(text)
    one = F.try_variant_get(v, "$[1]", "variant").isNull() & F.startswith(F.schema_of_variant(v), F.lit("ARRAY<OBJECT"))
    return F.coalesce(one & F.endswith(F.rtrim(text, F.lit(" \n\r\t")), F.lit("}")), F.lit(False))


def json_object(text: Column) -> Column:
    """The JSON object of a text as text: whole or fenced; else from its first to its last brace; else null.

    A text that is whole JSON of another kind has none.
    """
    t = without_fence(text)
    cut = braces(t)
    return F.when(is_object(t), t).when(_enclosed(t).isNull() & is_object(cut), cut)


def tagged(text: Column, tag: str) -> Column:
    """What the first pair of a tag holds, trimmed; empty if there is none."""
    return F.trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def boxed(text: Column) -> Column:
    return F.regexp_extract(text, r"\\boxed\{([^{}]*)\}", 1)


def reward_number(text: Column) -> Column:
    return F.regexp_extract(text, r"Reward:\s*([0-1](?:\.\d+)?)", 1).try_cast("double")


def after_last(text: Column, mark: str) -> Column:
    """What follows the last occurrence of a mark, trimmed; null where it doesn't occur."""
    return F.when(F.contains(text, F.lit(mark)), F.trim(F.substring_index(text, mark, -1)))


def media_kind(path: Column) -> Column:
    """Image, video or audio by the file ending; else null."""
    e = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(e.isin("jpg", "jpeg", "png", "gif", "webp", "bmp"), "image")
        .when(e.isin("mp4", "mkv", "mov", "avi", "mpeg", "webm"), "video")
        .when(e.isin("mp3", "wav", "flac", "ogg", "m4a"), "audio")
    )
