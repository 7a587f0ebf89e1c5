import html
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segloom.llm import endings
from segloom.llm.truncation import VARIANTS, cut, lengths, limits, readings

WHOLE = json.dumps({"segments": [{"start_time": 0.0, "reason": 'He says "hi" and [waves].'}, {"reason": "é {x}"}]})


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_lengths(text):
    text = text.encode("utf-8", "ignore").decode()
    got = dict(zip(VARIANTS, lengths(text), strict=False))
    crlf = text.replace("\r\n", "\n").replace("\n", "\r\n")
    assert got["points"] == len(text) and got["utf16"] == len(text.encode("utf-16-le")) // 2 and got["bytes"] == len(text.encode())
    assert got["entities"] == len(html.escape(text)) and got["entity_bytes"] == len(html.escape(text).encode())
    assert got["crlf"] == len(crlf)
    control = sum(c < " " and c not in "\n\r\t" or c == "\x7f" for c in text)
    if not control:
        assert got["json"] == len(json.dumps(text)) - 2 and got["json_bytes"] == len(json.dumps(text, ensure_ascii=False).encode()) - 2


@pytest.mark.parametrize(
    "text",
    [WHOLE, f"```json\n{WHOLE}\n```", f"Here is the timeline:\n{WHOLE}", json.dumps(WHOLE), f"{WHOLE}\n\nThat is all.", f"{WHOLE}\n<|end|>", "A dog barks.", "A dog barks!  ", 'A dog "barks."', "A dog barks. 🙂", "A dog barks.\n```", "画面没有变化。", "Joy", "He asks: why?", "[]"],
)
def test_whole(text):
    assert endings.read(text).ending == endings.WHOLE


@pytest.mark.parametrize("n", range(12, len(WHOLE), 7))
def test_json_cut_anywhere(n):
    for text in (WHOLE[:n], f"```json\n{WHOLE[:n]}", f"Here is the timeline:\n{WHOLE[:n]}", WHOLE[:n] + "…", WHOLE[:n] + " [truncated]"):
        assert endings.read(text).ending == endings.CUT, text


@pytest.mark.parametrize(("text", "ending"), [("A dog bar", endings.OPEN), ("A dog barks. The", endings.OPEN), ("A dog bar...", endings.CUT), ("A dog. […]", endings.CUT), ("A dog bar <cut>", endings.CUT), ("画面没有变", endings.OPEN)])
def test_prose_cut(text, ending):
    assert endings.read(text).ending == ending


@pytest.mark.parametrize("text", [None, "", " \n", "​", "none", "N/A", "[empty]", "<answer></answer>", "<|end|>", "```\n[]\n```", "...", "?", '""', "{}", "(none)"])
def test_without_content(text):
    assert endings.blank(text)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "id long, source string, stopped boolean, text string, lengths int")


def test_limits_and_cuts(spark):
    sentence = "The é dog climbs over the fence and looks back. " * 20
    rows = [(i, "a", False, sentence.encode()[: 300 if i % 2 else 250 + i].decode("utf-8", "ignore")) for i in range(40)]
    rows += [(100 + i, "a", False, sentence[: sentence.index(".", 40 * (i % 9 + 1)) + 1]) for i in range(200)]
    rows += [(400, None, None, None), (401, None, None, ""), (402, None, None, "x " * 200_000), (403, "a", False, sentence[:48]), (403, "a", False, sentence[:48])]
    read = readings(table(spark, rows)).cache()
    found = {(r.source, r.variant, r.length) for r in limits(read).collect()}
    assert ("a", "bytes", 300) in found and all(s == "a" for s, _, _ in found)
    ids = {r.id for r in cut(read).collect()}
    want = {r[0] for r in rows if r[3] and not endings.blank(r[3]) and endings.read(r[3]).ending}
    assert ids == want and 402 in ids and 403 not in ids


def test_open_endings_where_prose_has_no_punctuation(spark):
    rows = [(i, "a", False, f"a note without an end {i}") for i in range(30)] + [(99, "a", True, "this one was stopped")]
    assert [r.id for r in cut(readings(table(spark, rows))).collect()] == [99]


def test_empty(spark):
    assert cut(readings(table(spark, []))).count() == 0


def test_other_sources_change_nothing(spark):
    """A text is judged by itself and by the limits of its own source, whatever other sources hold."""
    cuts = ["A dog climbs over the fence and lo", "The man waits. Then he", "It rains, so the crowd le"]
    own = [(i, "a", False, t) for i, t in enumerate(cuts)]
    for style in ("A cat sleeps.", "no full stop here"):
        for n in (0, 7, 12, 60):
            rows = own + [(100 + i, "b", False, f"{style} {i}" if style[0] == "n" else style) for i in range(n)]
            assert {r.id for r in cut(readings(table(spark, rows))).collect()} == {0, 1, 2}


def test_limit_decides_what_the_text_leaves_open(spark):
    """Lower-case notes without punctuation, and single words, are cut where they lie at a limit of their source."""
    notes = "lorem ipsum dolor sit amet " * 30
    rows = [(i, "a", False, (f"n{i} " + notes)[:200]) for i in range(30)] + [(50 + i, "a", False, f"n{i} " + notes[: 60 + 6 * i].rstrip()) for i in range(20)]
    rows += [(90, "a", False, "x" * 200), (91, "b", False, "x" * 200), (92, "b", False, ("n " + notes)[:200])]
    got = {r.id: r.rule for r in cut(readings(table(spark, rows))).collect()}
    assert got == dict.fromkeys([*range(30), 90], "limit")


def test_token_limit(spark):
    text = "some words that go on and on without any end whatever comes of it "
    rows = [(i, "a", False, (text * 4)[: 100 + 3 * i], 128) for i in range(30)] + [(50 + i, "a", False, (text * 4)[: 110 + 3 * i].rstrip(), 90 + 2 * (i % 9)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, source string, stopped boolean, text string, tokens int")
    assert {r.id for r in cut(readings(df)).collect()} == set(range(30))
    assert ("tokens", 128) in {(r.variant, r.length) for r in limits(readings(df)).collect()}
