"""Tool calls in model text: several ways of writing them, one result ``array<struct<name, arguments>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = "array<struct<name:string,arguments:string>>"


def _json_calls(texts: Column, names: tuple[str, ...] = ("$.name",), arguments: tuple[str, ...] = ("$.arguments", "$.parameters")) -> Column:
    first = lambda x, paths: F.coalesce(*(F.get_json_object(x, p) for p in paths))
    calls = F.transform(texts, lambda x: F.struct(first(x, names).alias("name"), first(x, arguments).alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull())


def tagged_json(text: Column, tag: str = "tool_call") -> Column:
    """JSON objects between tags."""
    return _json_calls(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>\s*(\{{.*?\}})\s*</{tag}>"), F.lit(1)))


def bracketed_json(text: Column, mark: str) -> Column:
    """JSON objects of the list that follows a mark."""
    body = F.regexp_extract(text, rf"(?s){mark}\s*\[(.*)\]", 1)
    return _json_calls(F.filter(F.split(body, r"(?<=\})\s*,\s*(?=\{)"), lambda x: x != ""))


def xml_parameters(text: Column) -> Column:
    """``<function=name><parameter=key>value</parameter>...</function>``; arguments as a JSON object of strings."""
    functions = F.regexp_extract_all(text, F.lit(r"(?s)(<function=[^>]+>.*?</function>)"), F.lit(1))

    def call(x: Column) -> Column:
        keys = F.regexp_extract_all(x, F.lit(r"<parameter=([^>]+)>"), F.lit(1))
        values = F.transform(F.regexp_extract_all(x, F.lit(r"(?s)<parameter=[^>]+>(.*?)</parameter>"), F.lit(1)), lambda v: F.trim(v, F.lit(" \n")))
        return F.struct(F.regexp_extract(x, r"<function=([^>]+)>", 1).alias("name"), F.to_json(F.map_from_arrays(keys, values)).alias("arguments"))

    return F.transform(functions, call)


def keyed_arguments(text: Column) -> Column:
    """``name`` followed by ``<arg_key>k</arg_key><arg_value>v</arg_value>`` pairs within a tag."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))

    def call(x: Column) -> Column:
        keys = F.regexp_extract_all(x, F.lit(r"<arg_key>(.*?)</arg_key>"), F.lit(1))
        values = F.regexp_extract_all(x, F.lit(r"(?s)<arg_value>(.*?)</arg_value>"), F.lit(1))
        return F.struct(F.trim(F.regexp_extract(x, r"^\s*([^<\n]+)", 1)).alias("name"), F.to_json(F.map_from_arrays(keys, values)).alias("arguments"))

    return F.transform(bodies, call)


def action(text: Column) -> Column:
    """The last ``Action:`` line and the last ``Action Input:``; null without either."""
    name = F.trim(F.regexp_extract(text, r"(?s).*Action:\s*([^\n]*)", 1))
    return F.when(F.contains(text, F.lit("Action:")) & F.contains(text, F.lit("Action Input:")), F.struct(name.alias("name"), F.trim(F.substring_index(text, "Action Input:", -1)).alias("arguments")))
