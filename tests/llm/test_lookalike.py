import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segloom.llm.lookalike import LOOKALIKES, Transducer, alike, classes, consistent

T = Transducer()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｈｅｌｌｏ，　ｗｏｒｌｄ！", "Hello, world!"), ("café", "café"), ("ca​fe​́", "café"), ("soft­hyphen", "softhyphen"), ("a b c", "a b c"), ("сοоl", "cool"), ("Аррlе", "Apple"),
        ("ệ", "ệ"), ("ệ", "ệ"), ("한", "한"), ("ｶﾞ", "ガ"), ("a\r\nb\rc", "a\nb\nc"), ("x﻿⁠y", "xy"), ("сámаra", "cámara"), ("ё", "ë"), ("‍", ""), ("á‎", "á"),
    ],
)
def test_same_form(a, b):
    assert T(a) == T(b)


@pytest.mark.parametrize(("a", "b"), [("cafe", "café"), ("A", "a"), ("a.", "a,"), ("1", "2"), ("a-b", "a–b"), ("it's", "it’s"), ("a b", "a  b"), ("й", "и"), ("0", "O"), ("l", "1"), ("ı", "i"), ("。", ".")])
def test_visible_differences_stay(a, b):
    assert T(a) != T(b)


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_idempotent_and_composed(text):
    out = T(text)
    assert T(out) == out and unicodedata.is_normalized("NFC", out)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_ways_to_compose_do_not_matter(text):
    assert T(unicodedata.normalize("NFD", text)) == T(text) == T(unicodedata.normalize("NFC", text))


def test_ascii_is_kept():
    text = "".join(map(chr, range(32, 127)))
    assert T(text) == text


def test_conflicts_are_refused():
    with pytest.raises(ValueError, match="both"):
        Transducer(LOOKALIKES | {"b": "а"})
    with pytest.raises(ValueError, match="changes again"):
        Transducer({"x": "у", "у": "х"})


def test_words_keep_their_script():
    russian = "Собака стоит у двери, и старый мост скрипит."
    assert T(russian) == russian
    assert T(russian.replace("о", "o").replace("с", "c").replace("у", "y").replace("а", "a")) == russian
    english = "The cat sat on a sofa, so we saw a coop."
    assert T(english.replace("a", "а").replace("o", "о").replace("c", "с")) == english
    assert T("Москва has a metro") == "Москва has a metro"
    assert T("Mocква") == T("Москва") == "Москва" and T("сор") == "cop"


@pytest.mark.parametrize("text", ["\u06dd١", "\u0600١٢", "👨\u200d👩\u200d👧", "می\u200cخواهم", "क्\u200dष", "❤\u200d🔥"])
def test_characters_that_are_seen_stay(text):
    assert T(text) == text.replace("\ufe0f", "")
    for c in "\u06dd\u0600\u200c\u200d":
        if c in text:
            assert T(text) != T(text.replace(c, ""))


def test_joiners_elsewhere_are_invisible():
    assert T("ca\u200dt") == T("ca\u200ct") == "cat" and T("👨\u200d") == "👨" and T("م\u200c") == "م"


def test_table_of_confusables(spark):
    from segloom.llm.lookalike import confusables

    table = confusables(spark)
    assert all(set(forms) <= set(table[t]) for t, forms in LOOKALIKES.items()) and sum(map(len, table.values())) > sum(map(len, LOOKALIKES.values()))
    wide = Transducer(table)
    assert wide("ᏀᎪᎷᎬ") == "GAME" and wide("Собака стоит") == "Собака стоит"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, form string")


def brute(texts):
    f = [None if t is None else T(t) for t in texts]  # the built-in letters do for these texts
    return sorted((i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if f[i] is not None and f[i] == f[j] and texts[i] != texts[j])


def test_pairs_against_brute_force(spark):
    texts = ["abc", "аbc", "ab​c", "abc", None, "", "​", "", "ABC", "x" * 200_000, "x" * 199_999 + "х", "abç", "abç"] * 2
    df = documents(spark, texts)
    got = sorted((r.doc_id_a, r.doc_id_b) for r in alike(classes(df)).collect())
    assert got == brute(texts)
    assert alike(classes(df.union(df))).count() == len(got)


def test_forms_and_empty_table(spark):
    assert [r.form for r in consistent(documents(spark, ["ａ", None])).collect()] == ["a"]
    assert alike(classes(documents(spark, []))).count() == 0
