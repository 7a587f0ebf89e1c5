"""Where a text ends: inside a JSON value, a word or a sentence, or where its answer does."""

from __future__ import annotations

import json
import re

WHOLE, OPEN, CUT = 0, 1, 2

_DECODER = json.JSONDecoder(strict=False)
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*")
_OPENING = re.compile(r'[\[{]\s*(?:["\[{\]}\-\d]|$|true|false|null)')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_BRACKETS = re.compile(r"[^\[\]{}]+")
# Marks that transport or storage leave at a cut.
_MARK = re.compile(
    r"(?:\.\.\.|…|[\[(<]\s*(?:truncated|cut(?: off)?|snip(?:ped)?|\.\.\.|…|continued|more|output limit(?: reached)?|max(?:imum)? (?:length|tokens)"
    r"(?: reached)?)\s*[\])>])\s*[\"'”»`]*\s*$",
    re.IGNORECASE,
)
_TAG = re.compile(r"<[^<>\s]{1,24}>|<\|[^<>]{1,24}\|>")
_TAIL = re.compile("(?:\\s|```|[\"'”»)\\]*_~]|[←-⏿☀-➿️‍\U0001f000-\U0001faff])+$")
_TERMINAL = frozenset(".!?。！？।؟｡．")
_BLANK = re.compile(r"[^\w]+")
# What stands for no answer, without case and punctuation.
PLACEHOLDERS = frozenset(
    ["", "none", "null", "na", "nil", "nan", "empty", "end", "endoftext", "eos", "json", "tbd", "todo", "undefined", "answer", "noanswer",
     "noresponse", "nocontent", "blank", "unknown", "missing", "placeholder", "output", "response", "无", "нет", "keine", "ninguno", "aucun"]
)


def blank(text: str | None) -> bool:
    """Null, blank, or a mere placeholder."""
    if text is None:
        return True
    if len(text) > 64:
        return not text.strip()
    bare = _TAG.sub("", text.replace("```json", "").replace("```", "")).strip()
    if _BLANK.sub("", bare.lower()).replace("_", "") in PLACEHOLDERS:
        return True
    return bool(re.fullmatch(r"<\|?\w*\|?>", text.strip()))


class Reading:
    """A text as its answer: ``value`` (JSON, if any), ``ending`` and the prose around or instead of the value."""

    __slots__ = ("ending", "json", "rest", "value")

    def __init__(self, value, ending: int, is_json: bool, rest: str = ""):
        self.value, self.ending, self.json, self.rest = value, ending, is_json, rest


def prose_ending(text: str) -> int:
    """CUT with a mark of it; OPEN without final punctuation (two words or more); else WHOLE."""
    if _MARK.search(text):
        return CUT
    body = text
    while True:
        shorter = _TAIL.sub("", body)
        if shorter[-1:] == ">":
            shorter = re.sub(r"<[^<>]{1,26}>$", "", shorter)
        if shorter == body:
            break
        body = shorter
    if not body:
        return WHOLE
    if body[-1] in _TERMINAL:
        return WHOLE
    tail = body[-80:]
    words = len(tail.split())
    return OPEN if words > 1 or (ord(tail[-1]) > 0x2E80 and len(tail) > 3) else WHOLE


_INNER = re.compile(r"[\w\"'”»)][,;:.!?](?:\s|$)|[，、；：。！？]")


def punctuates(text: str) -> bool:
    """Whether a text ought to end in punctuation: it has some inside, or six words or more, the first one with a capital and not
    all, or goes on for a hundred words and more."""
    if _INNER.search(text):
        return True
    words = text.split()
    return len(words) >= 100 or len(words) > 5 and words[0][:1].isupper() and any(w[:1].islower() for w in words[1:])


def bare(text: str) -> bool:
    """A single word without any punctuation after it: the text alone doesn't tell whether more was to come."""
    return text.rstrip()[-1:].isalnum()


def unclosed(text: str) -> bool:
    """Whether a JSON text ends within a string or with open brackets."""
    bare = _STRING.sub("", text)
    if '"' in bare:
        return True
    depth = 0
    for c in _BRACKETS.sub("", bare):
        depth += 1 if c in "[{" else -1
    return depth > 0


def read(text: str) -> Reading:
    """Reads a text that isn't ``blank``."""
    body = _FENCE.sub("", text, count=1).lstrip()
    if body[:1] == '"':
        try:
            value, end = _DECODER.raw_decode(body)
        except (ValueError, RecursionError):
            if body[1:2] in "{[" and body[2:3] in '\\ {["':
                return Reading(None, CUT, True)
            return Reading(None, prose_ending(text), False, body)
        inner = value.lstrip()
        if inner[:1] in ("{", "["):
            return read(value)
        return Reading(None, prose_ending(body), False, body)
    at = _OPENING.search(body)
    if at is None or at.start() > 120:
        return Reading(None, prose_ending(text), False, body)
    lead = body[: at.start()]
    try:
        value, end = _DECODER.raw_decode(body, at.start())
    except (ValueError, RecursionError):
        if lead and not lead.rstrip().endswith(":"):
            return Reading(None, prose_ending(text), False, body)
        return Reading(None, CUT if unclosed(body[at.start() :]) else WHOLE, True, lead)
    if lead and not isinstance(value, (dict, list)):
        return Reading(None, prose_ending(text), False, body)
    after = body[end:].strip()
    if lead and len(after) > 200 and not isinstance(value, dict):
        return Reading(None, prose_ending(text), False, body)
    ending = WHOLE
    if after and not after.startswith("```"):
        ending = prose_ending(after) if _BLANK.sub("", after) else WHOLE
    return Reading(value, ending, True, after)
