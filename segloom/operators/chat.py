"""Operators on conversations, an array of ``struct<role, content>`` per record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<role:string,content:string>>"
# The roles of the other dialect by those of this one.
ROLES = {"human": "user", "gpt": "assistant", "tool_response": "tool", "function_call": "tool_call", "observation": "tool"}


def _role(x: Column) -> Column:
    out = F.when(x.isNull(), x)
    for a, b in ROLES.items():
        out = out.when(x == a, b)
    return out.otherwise(x)


def messages(turns: Column) -> Column:
    """``from, value`` turns as ``role, content`` messages, roles renamed."""
    return F.transform(turns, lambda t: F.struct(_role(t["from"]).alias("role"), t["value"].alias("content")))


def has_system(m: Column) -> Column:
    return F.coalesce(F.get(m, 0)["role"] == "system", F.lit(False))


def system_of(m: Column) -> Column:
    return F.when(has_system(m), F.get(m, 0)["content"])


def without_system(m: Column) -> Column:
    return F.when(has_system(m), F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)


def last_of(m: Column, role: str) -> Column:
    """The place of the last message of a role from 0; -1 if there is none."""
    return F.coalesce(F.array_max(F.transform(m, lambda x, i: F.when(x["role"] == role, i).otherwise(-1))), F.lit(-1))


def last_reply(m: Column) -> Column:
    return F.get(m, last_of(m, "assistant"))["content"]


def popped(m: Column) -> tuple[Column, Column]:
    """The conversation without a final reply, and that reply (null if the last message is none)."""
    last = F.element_at(m, -1)
    is_reply = F.coalesce(F.when(F.size(m) > 0, last["role"] == "assistant"), F.lit(False))
    return F.when(is_reply, F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m), F.when(is_reply, last["content"])


def flat(m: Column) -> Column:
    """Lines ``Role: content`` of the messages that aren't empty."""
    said = F.filter(m, lambda x: F.coalesce(F.trim(x["content"]), F.lit("")) != "")
    return F.array_join(F.transform(said, lambda x: F.concat(F.initcap(x["role"]), F.lit(": "), x["content"])), "\n")


def rejected(m: Column, answer: Column) -> Column:
    """The conversation up to its last question with another answer; null if that is the answer it has."""
    n = last_of(m, "user")
    return F.when((n >= 0) & ~answer.eqNullSafe(last_reply(m)), F.concat(F.slice(m, F.lit(1), n + 1), F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))))


def exchanges(m: Column) -> Column:
    """``query, response`` of every second message and the one after it."""
    n = F.floor((F.size(m) + 1) / 2).cast("int")
    pair = lambda i: F.struct(F.get(m, 2 * i)["content"].alias("query"), F.get(m, 2 * i + 1)["content"].alias("response"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), pair)).otherwise(F.array().cast("array<struct<query:string,response:string>>"))


def without_thinking(m: Column) -> Column:
    """What replies before the last question say up to ``</think>`` is cut off."""
    last = last_of(m, "user")
    cut = lambda x: F.trim(F.substring_index(x, "</think>", -1), F.lit(" \n\r\t"))
    return F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), F.when((x["role"] == "assistant") & (i < last), cut(x["content"])).otherwise(x["content"]).alias("content")))


def with_tags(m: Column, tag: str, wanted: Column) -> Column:
    """Missing media tags put before the first message; nothing is taken off where there are too many."""
    have = F.aggregate(m, F.lit(0), lambda a, x: a + F.coalesce(F.regexp_count(x["content"], F.lit(tag)), F.lit(0)))
    add = F.repeat(F.lit(tag), F.greatest(wanted - have, F.lit(0)))
    return F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), F.when(i == 0, F.concat(add, F.coalesce(x["content"], F.lit("")))).otherwise(x["content"]).alias("content")))
