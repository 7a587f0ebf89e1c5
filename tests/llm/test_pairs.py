import json

import pytest

from segloom.llm import languages, pairs

Q = "Watch the clip (5.1s) and report, as JSON, every stretch with one dominant viewer emotion and why it arises."


def js(*reasons):
    return json.dumps({"segments": [{"start_time": 0.0, "emotion": "Joy", "reason": r} for r in reasons]}, ensure_ascii=False)


SCENE = "The sound drops out, a barefoot drummer hides behind the cracked mirror, and real unease returns."
GERMAN = "Der Schnitt ist hart; ruhige Freude weicht nun einer Überraschung."


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        (Q, None, "empty"), (Q, " ", "empty"), (Q, '{"segments": []}', "empty"), (Q, '{ "segments" : null }', "empty"), (Q, "[]", "empty"), (Q, '{"answer": ""}', "empty"), (Q, '{"result": {"version": 1, "segments": []}}', "empty"),
        (Q, js(SCENE), None), (Q, f"```json\n{js(SCENE)}\n```", None), (Q, SCENE, None), (Q, js(SCENE)[:-20], "truncated"), (Q, SCENE[:40], "truncated"), (Q, json.dumps(js(SCENE)), None),
        (Q, Q, "copy"), (Q, f'"{Q}"', "copy"), (Q, Q.lower(), "copy"), (Q, f"Question: {Q}", "copy"), (Q, f"{Q} {Q}", "copy"), (Q, json.dumps({"answer": Q}), "copy"), (Q, Q.replace("report, ", ""), "copy"), (Q, f"{Q}\n{SCENE}", None),
        (Q, GERMAN, "language"), (Q, js(GERMAN, GERMAN), "language"), (f"{Q} Please answer in German.", js(GERMAN), None), (Q, "画面没有变化，但流浪狗仍然站在桥洞下。", "language"), ("Warum ändert sich das Gefühl bei 8.3 Sekunden?", SCENE, "language"),
        (Q, f"{SCENE} The sign reads «salida por aquí».", None), (Q, f"He says “bis morgen, mein Freund” and leaves. {SCENE}", None), ("What exactly is visible around 1.7 s?", GERMAN, "language"), (None, GERMAN, None), (None, None, "empty"),
    ],
)
def test_single_pairs(question, answer, defect):
    assert pairs.Judge()(question, answer)[0] == defect


REFUSALS = [
    "I cannot assist with that.", "I'm sorry, but I have no access to the video. I hope you understand.", "As a text-only assistant, there is no way for me to open the video.", "Leider darf ich dieses Video nicht beurteilen.",
    "Je suis désolé, mais je ne peux pas traiter cette vidéo.", "Debo rechazar esta tarea.", "Tôi xin từ chối trả lời câu hỏi này.", "Thank you for the question. However, the policy I follow rules out a statement about this clip.", "Hm, I have to pass on this one. Please ask something else.",
]
SOUND = [
    "She says: I cannot help you, please leave.", "The coach said: I refuse to answer. I cannot comment.", f"I am not able to say who wins, only that tension rises. {SCENE}", f"{SCENE} I can't rule out a second person, but the frames show one.", "The guard refuses to help and declines the gift with a nod.", f"I'm sorry to correct myself: the turn comes slightly earlier. {SCENE}",
]


@pytest.mark.parametrize("text", REFUSALS)
def test_refusals(text):
    for answer in (text, js(text)):
        _, opening, declines, speaks = pairs.Judge()(Q, answer)
        assert declines and speaks and opening
        said = pairs.Judge().judge(Q, answer)[1]
        assert said.sentences and set(said.sentences) <= set(said.units)


@pytest.mark.parametrize("text", SOUND)
def test_no_refusals(text):
    assert not pairs.Judge()(Q, text)[3]


def frame(spark, rows):
    return spark.createDataFrame([("t", i, 1, q, a, "x", 9) for i, (q, a) in enumerate(rows)], "record_table string, record_id long, turn_no long, question string, answer string, opening string, declines int")


def test_broken(spark):
    rows = [(Q, a) for a in REFUSALS] + [(Q, a) for a in SOUND] + [(Q, js(SCENE)), (Q, None), (None, None), (None, "x" * 300_000), (Q, "")]
    df = frame(spark, rows)
    got = {r.record_id: r.defect for r in pairs.broken(df.union(df)).collect()}
    n, m = len(REFUSALS), len(SOUND)
    assert {i: d for i, d in got.items() if i < n + m} == dict.fromkeys(range(n), "refusal")
    assert got[n + m + 1] == got[n + m + 2] == got[n + m + 4] == "empty" and n + m not in got


def test_templates_reveal_refusals_of_other_words(spark):
    odd = "Let us leave your request where it is, my friend of the archive."
    questions = [f"{w} is seen at {i}.0 s, and why is it there?" for i, w in enumerate(["What", "Who", "Which dog", "Whose hat"])]
    got = {r.record_id: r.defect for r in pairs.broken(frame(spark, [(q, odd) for q in questions])).collect()}
    assert got == dict.fromkeys(range(4), "refusal")
    assert pairs.broken(frame(spark, [(questions[0], odd)] * 4)).count() == 0


LONG = (
    "My dear friend of the archive, let us leave your {} where it is today, since I was told by the people in charge of the project that you will hear from me "
    "about such things only after the board has met, and until then I keep to what was agreed with them and with you in the {} of last spring."
)


def test_templates_of_long_wordings(spark):
    """Two long wordings that differ in their openings and later are one template: it declines in one of them."""
    near, far = LONG.format("request", "talks"), LONG.format("question", "talks").removesuffix(".") + ", so I decline."
    assert [pairs.Judge()(Q, a)[2:] for a in (near, far)] == [(False, True), (True, True)]
    rows = [(Q, near), ("Who is seen at 3.0 s?", far), (Q, SCENE)]
    assert {r.record_id: r.defect for r in pairs.broken(frame(spark, rows)).collect()} == {0: "refusal", 1: "refusal"}


def test_questions_of_a_cluster(spark):
    """Near wordings under one question each are a template by the questions of all of them."""
    answers = [LONG.format(w, "talks") for w in ("request", "question", "message")]
    rows = [(f"{w} is seen at {i}.0 s, and why?", a) for i, (w, a) in enumerate(zip(("What", "Who", "Which dog"), answers))]
    assert {r.record_id: r.defect for r in pairs.broken(frame(spark, rows)).collect()} == dict.fromkeys(range(3), "refusal")
    assert pairs.broken(frame(spark, [(rows[0][0], a) for a in answers])).count() == 0


def test_templates_at_the_limit(spark):
    """Wordings of one question each that are just near enough to be a template, of many templates: none is missed."""
    rows = []
    for i in range(40):
        words = ["my", *(f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}a{b}" for a in "klm" for b in "aeiou")]
        cuts = (" ".join(words[-12:]), " ".join(words[-14:]), " ".join(words))  # 8, 10 and 12 runs of five words
        rows += [(f"{w} is seen at {n}.0 s, and why?", f"{cut}.") for n, (w, cut) in enumerate(zip(("What", "Who", "Which dog"), cuts))]
    rows += [(f"Question number {i}?", a) for i, a in enumerate(scenes(100))]
    got = {r.record_id for r in pairs.broken(frame(spark, rows), patterns=False).filter("defect = 'refusal'").collect()}
    assert got == set(range(120)), len(got)


def test_templates_by_core(spark):
    """The same refusing sentence after unlike leads."""
    odd = "Let us leave your request where it is, my friend of the archive."
    rows = [(f"{w} is seen at {i}.0 s, and why is it there?", f"{lead} {odd}") for i, (w, lead) in enumerate([("What", "Well."), ("Who", "Dear you, it is me again and I am pleased."), ("Which dog", "I read your words with great care.")])]
    assert {r.record_id: r.defect for r in pairs.broken(frame(spark, rows)).collect()} == dict.fromkeys(range(3), "refusal")


def test_conversation_pairs(spark):
    t = lambda *x: [{"from": a, "value": b} for a, b in x]
    df = spark.createDataFrame([(1, t(("system", "s"), ("human", "q"), ("gpt", "a"), ("human", "q2"), ("human", "q3"), ("gpt", None))), (2, []), (3, None), (4, t(("gpt", "a")))], "row_id long, conversations array<struct<from:string,value:string>>")
    got = sorted((r.record_id, r.turn_no, r.question, r.answer) for r in pairs.conversation_pairs(df, "t").collect())
    assert got == [(1, 2, "q", "a"), (1, 5, "q3", None)]


def test_empty(spark):
    assert pairs.broken(frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "lang"),
    [("the dog is here and waits", "en"), ("Der Hund und die Katze sind nicht da", "de"), ("le chien est dans la rue", "fr"), ("el perro sigue en la calle", "es"), ("con mèo vẫn đứng trong nhà", "vi"), ("собака стоит у двери", "ru"), ("画面没有变化", "zh"), ("これはペンです", "ja"), ("", None), ("12 34", None), ("Xyzzy", None)],
)
def test_languages(text, lang):
    assert languages.language(text) == lang


def test_asked_for():
    assert languages.asked_for("Please reply in Spanish.") == {"es"} and languages.asked_for("kèm lý do bằng tiếng Việt") == {"vi"} and languages.asked_for("auf Deutsch") == {"de"}


def scenes(n, seed=0):
    """Elaborate answers of made-up words, one vocabulary for all."""
    import random

    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("bar", "kel", "mo", "ru", "ti") for b in ("la", "ne", "so", "vi", "da") for c in ("", "n", "rk", "st", "m", "l")]
    sentence = lambda: f"The {' '.join(rng.choice(words) for _ in range(8))} and so no more is to be seen."
    return [" ".join(sentence() for _ in range(5)) for _ in range(n)]


UNLISTED = "Answering this falls beyond the remit of the service so no result can be produced."


def test_template_in_unlisted_wording(spark):
    """A template that no pattern knows is found whole by its recurrence; describing answers that recur as often aren't."""
    import random

    assert not pairs.DECLINE.search(UNLISTED) and not pairs.ADDRESS.search(UNLISTED)
    rng = random.Random(3)
    ask = lambda: f"{' '.join(rng.sample('why who what which where when how does did the a dog man hat light door sea run'.split(), 9))}?"
    rows = [(ask(), a) for a in scenes(300)]
    rows += [(ask(), f"{lead}{UNLISTED}") for lead in ["", "Greetings. ", "Hereby declared: "] * 14]
    often = scenes(1)[0].split(". ")[0] + "."
    rows += [(ask(), often) for _ in range(42)] + [(ask(), "Yes.") for _ in range(9)]
    df = frame(spark, rows)
    for patterns in (True, False):
        got = {r.record_id: r.defect for r in pairs.broken(df, patterns).collect()}
        assert {i for i, d in got.items() if d == "refusal"} == set(range(300, 342)), patterns
    one = frame(spark, [(rows[0][0], UNLISTED)] * 9 + rows[:300])
    assert pairs.broken(one).filter("defect = 'refusal'").count() == 0  # one question only


def test_clusters_hold_several_wordings(spark):
    base = "Dear sender of this enquiry the committee regrets that nothing further about the matter named above is to be handed over by its office until the board has met again in {}"
    rows = [(f"{w} is seen at {i}.0 s, and why?", base.format(m)) for i, (w, m) in enumerate(zip(("What", "Who", "Which dog"), ("march", "april", "may")))] + [(f"Question number {i}?", a) for i, a in enumerate(scenes(100))]
    t = pairs.templates(*pairs.candidates(pairs.judged(frame(spark, rows)))).collect()
    by = {}
    for r in t:
        by.setdefault(r.cluster, set()).add(r.text)
    assert max(map(len, by.values())) >= 3
    assert {r.record_id for r in pairs.broken(frame(spark, rows), patterns=False).filter("defect = 'refusal'").collect()} == {0, 1, 2}


def test_shuffled_instead_of_sent(spark):
    """Beyond the bound of what is sent to every task the joins shuffle, with the same result."""
    rows = [(f"{w} is seen at {i}.0 s?", UNLISTED) for i, w in enumerate(("What", "Who", "Which dog", "Why"))] + [(Q, a) for a in REFUSALS + scenes(80)]
    want = sorted(map(tuple, pairs.broken(frame(spark, rows)).collect()))
    spark.conf.set("spark.segloom.mostSent", "0")
    try:
        assert sorted(map(tuple, pairs.broken(frame(spark, rows)).collect())) == want and len(want) >= 4 + len(REFUSALS)
    finally:
        spark.conf.unset("spark.segloom.mostSent")


def test_stopped_runs():
    judge = pairs.Judge()
    assert judge.judge(Q, "Jo", True)[0] == "truncated" and judge.judge(Q, "Joy", False)[0] is None and judge.judge(Q, "Joy.", True)[0] is None
