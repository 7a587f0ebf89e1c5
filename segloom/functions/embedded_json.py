"""JSON values held in free text: whole, fenced, quoted as a JSON string, or followed and preceded by prose."""

from __future__ import annotations

import json
import re

_DECODER = json.JSONDecoder(strict=False)
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*")
_OPENING = re.compile(r'[\[{]\s*(?:["\[{\]}\-\d]|$|true|false|null)')


def find_value(text: str | None):
    """The first object or array in ``text``; None if there is none or if it breaks off.

    A JSON string whose content is JSON is opened, up to three times. What follows the value is ignored, so prose or an
    end mark may follow; a value that doesn't end is never repaired and its inner values aren't taken for it.
    """
    for _ in range(4):
        if not text:
            return None
        body = _FENCE.sub("", text, count=1).lstrip()
        if body[:1] == '"':
            try:
                value, _end = _DECODER.raw_decode(body)
            except (ValueError, RecursionError):
                return None
            text = value
            continue
        at = _OPENING.search(body)
        if not at:
            return None
        try:
            return _DECODER.raw_decode(body, at.start())[0]
        except (ValueError, RecursionError):
            return None
    return None
