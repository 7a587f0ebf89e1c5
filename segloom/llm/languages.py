"""Which language a short text is written in, by script and by common words."""

from __future__ import annotations

import re
from collections import Counter

# Common words of the languages of Latin script.
COMMON = {
    "en": "the a an and of to in is are was were it that this with for on at by from as but not so while when which what who how you your i we they his her its there into once most again does do be have has had will would can could after before yet about without under behind where why each any same most exactly describe which tell explain write watch give",
    "de": "der die das den dem des ein eine einen einem einer und oder aber ist sind war nicht nichts mit auf im am zu zum zur von vom aus bei nach vor wie wenn weil denn dass sich es er sie ich wir für über unter neben durch noch nur auch kurz beim dann nun wird werden hat haben kann obwohl man sieht dort wo jedes warum was ändert beschreibe schreibe welche welches ungefähr",
    "fr": "le la les un une des du de et ou mais est sont dans sur avec pour par pas ne ce cette ces qui que quoi où sous comme sans ni se il elle on nous vous je son sa ses au aux plus très après avant car sauf rien fin plan laisse place vers près donc d l qu n s c pourquoi comment quel quelle quels voit secondes elles quand chaque",
    "es": "el la los las un una unos unas del de y o pero es son en con por para no se que qué cómo su sus al lo como más muy sin sobre bajo entre hasta desde ya porque nada ve cuando donde este esta segundos después junto cerca mientras ocurre sigue cada cierta alrededor cuál quién dónde",
    "vi": "và của không có một người những các cái là được trong với nhưng vẫn đứng cho này khi ở tại trên dưới gần bên rất sau trước giây cuối cùng nên thấy sự đã đang vì lên xuống ra vào lại đến hãy từng gì nào chuyển thành chiếc con chú cô anh bác tôi tại sao khoảng giải thích viết",
    "it": "il lo gli una e è sono nel nella con per che non si di del della dei delle al alla come più dopo prima sotto sopra mentre quando questo questa anche molto ma poi ogni senza",
    "pt": "o os um uma e é são no na nos nas com por para não que do da dos das ao à como mais depois antes sob sobre enquanto quando este esta também muito mas sem cada já seu sua",
    "nl": "het een en van is zijn niet met op te aan voor door bij naar uit maar ook dan wordt worden dat die deze er om nog wel geen over onder tussen waar wanneer",
}
# How a language is called when an answer in it is asked for.
NAMES = {
    "en": "english englisch anglais inglés inglese",
    "de": "german deutsch deutsche deutscher allemand alemán",
    "fr": "french französisch français francés",
    "es": "spanish spanisch espagnol español castellano",
    "vi": "vietnamese vietnamesisch vietnamien vietnamita việt",
    "it": "italian italienisch italien italiano",
    "pt": "portuguese portugiesisch portugais portugués português",
    "nl": "dutch niederländisch néerlandais neerlandés nederlands",
    "zh": "chinese chinesisch chinois chino mandarin 中文 汉语",
    "ru": "russian russisch russe ruso русском русский",
    "ja": "japanese japanisch japonais japonés 日本語",
    "ko": "korean koreanisch coréen coreano 한국어",
}
_BY_WORD: dict[str, tuple[str, ...]] = {}
for _lang, _words in COMMON.items():
    for _w in _words.split():
        _BY_WORD[_w] = (*_BY_WORD.get(_w, ()), _lang)
_NAMED = {w: lang for lang, words in NAMES.items() for w in words.split()}
_WORDS = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"]*\"|「[^」]*」|『[^』]*』|‹[^‹›]*›")
_SCRIPTS = (
    ("zh", re.compile("[㐀-鿿]")),
    ("ru", re.compile("[Ѐ-ӿ]")),
    ("ja", re.compile("[぀-ヿ]")),
    ("ko", re.compile("[가-힯]")),
    ("ar", re.compile("[؀-ۿ]")),
    ("hi", re.compile("[ऀ-ॿ]")),
    ("th", re.compile("[฀-๿]")),
    ("el", re.compile("[Ͱ-Ͽ]")),
    ("he", re.compile("[֐-׿]")),
)
_OTHER = re.compile("[\u0370-\u1aff\u2e80-\ud7ff]")
_VIETNAMESE = re.compile("[đăơưĐĂƠƯẠ-ỹ]")
#: A language is named only from this many points on, and with this lead over the next.
LEAST, LEAD = 1.0, 1.5


def unquoted(text: str) -> str:
    """The text without phrases in quotation marks."""
    return _QUOTED.sub(" ", text) if any(q in text for q in "«“„\"「『‹") else text


def asked_for(question: str) -> set[str]:
    """Languages that a question names."""
    return {_NAMED[w] for w in _WORDS.findall(question.lower()) if w in _NAMED} | {
        lang for w, lang in _NAMED.items() if ord(w[0]) > 0x2E80 and w in question
    }


def language(text: str) -> str | None:
    """The language of a text, or None where too little tells. Read it without quoted phrases.

    A script other than Latin decides if it has a third of the letters (a Chinese character counts as three).
    """
    words = text.lower().split()  # punctuation stays on; the words that count are common enough without it
    if not text.isascii():
        letters = sum(map(len, _WORDS.findall(text)))
        counts = {lang: n for lang, pattern in _SCRIPTS if (n := len(pattern.findall(text)))} if _OTHER.search(text) else {}
        if counts:
            if "ja" in counts:
                counts["ja"] += counts.pop("zh", 0)
            lang = max(counts, key=lambda k: counts[k] * (3 if k in ("zh", "ja") else 1))
            n = counts[lang]
            if n >= 2 and n * (3 if lang in ("zh", "ja") else 1) >= (letters + 2 * n * (lang in ("zh", "ja"))) / 3:
                return lang
    score: dict[str, float] = {}
    for langs, n in Counter(map(_BY_WORD.get, words)).items():
        for lang in langs or ():
            score[lang] = score.get(lang, 0.0) + (n if len(langs) == 1 else n / 2)
    if not text.isascii():
        marks = len(_VIETNAMESE.findall(text))
        if marks:
            score["vi"] = score.get("vi", 0.0) + marks * (1 if marks > 1 else 0.5)
    if not score:
        return None
    ranked = sorted(score.items(), key=lambda kv: -kv[1])
    if ranked[0][1] < LEAST or (len(ranked) > 1 and ranked[0][1] < LEAD * ranked[1][1]):
        return None
    return ranked[0][0]
