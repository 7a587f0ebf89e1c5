"""One consistent form for texts that look the same.

A transducer is compiled from declared rules (width forms, spaces, invisible characters, look-alike letters) and applied
in one pass: the text is cut into grapheme clusters by a longest match (a base with all marks and invisible characters
that follow it, a run of conjoining letters, emoji joined into one, a line end), and each cluster that can change is
replaced by its output. Letters, case, digits, punctuation and accents that can be seen are kept apart; so are format
characters that are seen themselves (U+06DD), and joiners where they change what is seen: between emoji, and between
letters of Arabic, Indic and like scripts. The rules are checked for conflicts when they are compiled: no output may be
rewritten again, and no two visible ASCII characters may meet.

Look-alike letters are those of the Unicode table of confusable characters, as the ICU library that ships with Spark holds
it, and a few more. They change by words: a word with letters that only one script has is brought to that script, one of
look-alikes only to the script that prevails in the text (Latin, if none does). So a Russian text stays Russian, with
Latin letters in it made Cyrillic, and a Latin text becomes Latin throughout.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter, by that letter; where they and the Unicode table disagree, they hold.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲᴄ", "d": "ԁժ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳյ", "k": "κ", "l": "ӏ",
    "n": "ոռ", "o": "оοօᴏ", "p": "рρ", "q": "ԛզ", "r": "ᴦ", "s": "ѕꜱ", "u": "սυᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "хχ", "y": "уγү",
    "z": "ᴢ", "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ",
    "K": "КΚᏦ", "L": "ᏞԼ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ",
    "W": "ԜᏔ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
}
# Characters without a shape besides the format characters (category Cf).
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
# Format characters that are seen.
SEEN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
# The blocks of scripts whose letters take part in words of look-alikes.
SCRIPTS = {
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)), "Armenian": ((0x530, 0x58F),),
    "Cherokee": ((0x13A0, 0x13FF), (0xAB70, 0xABBF)), "Coptic": ((0x2C80, 0x2CFF),),
}
# Blocks of emoji, and of scripts in which joiners shape letters.
_EMOJI = "\u2190-\u21ff\u2600-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff"
_SHAPED = "\u0600-\u0dff\u1000-\u109f\u1780-\u18af"
_JOINERS = "\u200c\u200d"
_WORDS = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")


def confusables(spark: SparkSession) -> dict[str, str]:
    """``letter: forms``: LOOKALIKES and, of SCRIPTS, the letters whose skeleton in the Unicode table is one ASCII letter."""
    letters = [chr(c) for blocks in SCRIPTS.values() for a, b in blocks for c in range(a, b + 1) if chr(c).isalpha() and unicodedata.is_normalized("NFD", chr(c))]
    known = {c for forms in LOOKALIKES.values() for c in forms}
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    out = dict(LOOKALIKES)
    for c, target in zip(letters, checker.getSkeleton("\u0001".join(letters)).split("\u0001"), strict=True):
        if c in known or len(target) != 1 or not (target.isascii() and target.isalpha()):
            continue
        target = "I" if target == "l" and c.isupper() else target  # the table has one form for I and l
        out[target] = out.get(target, "") + c
    return out


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}" + (f"-\\U{chars[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


class Transducer:
    """Rules compiled into one pattern over clusters and a memory of their outputs."""

    def __init__(self, lookalikes: dict[str, str] | None = None):
        self.char: dict[str, str] = {}
        of = {chr(c): name for name, blocks in SCRIPTS.items() for a, b in blocks for c in range(a, b + 1)}
        self.alike: dict[str, str] = {}
        self.inverse: dict[str, dict[str, str]] = {name: {} for name in SCRIPTS}
        table = LOOKALIKES if lookalikes is None else lookalikes
        for target, forms in table.items():
            for c in forms:
                held = self.alike.get(c, self.char.get(c, target))
                if held != target:
                    raise ValueError(f"{c!r} is to become both {held!r} and {target!r}")
                if c in of:
                    self.alike[c] = target
                else:
                    self.char[c] = target
        for c, target in self.alike.items():  # of several letters the first stands for all
            if target in self.alike or target in self.char:
                raise ValueError(f"{c!r} becomes {target!r}, which changes again")
            self.inverse[of[c]].setdefault(target, c)
        self.script = {c: name for c, name in of.items() if c.isalpha()}
        marks, jamo = [], list(range(0x1100, 0x1200))
        for code in range(0x80, 0x30000):
            c = chr(code)
            kind = unicodedata.category(c)
            if c in SEEN:
                continue
            if kind == "Cf" or c in INVISIBLE or 0xFE00 <= code <= 0xFE0F:
                self.char[c] = ""
                marks.append(code)
            elif kind in ("Mn", "Mc", "Me"):
                marks.append(code)
            elif kind == "Zs":
                self.char[c] = " "
            elif 0xFF00 <= code <= 0xFFEF:
                self.char[c] = unicodedata.normalize("NFKC", c)
                if unicodedata.combining(self.char[c][:1]):  # voiced sound marks of half width
                    marks.append(code)
        for c in range(0xE0000, 0xE01F0):  # tags and variation selectors
            self.char[chr(c)] = ""
            marks.append(c)
        self.char |= {"\r\n": "\n", "\r": "\n", "\u2028": "\n", "\u2029": "\n\n", "\x85": "\n"}
        self._check()
        known = set(marks)
        active = [c for c in range(0x80, 0x30000) if c not in known and not 0xD800 <= c < 0xE000 and self._output(chr(c)) != chr(c)]
        mark, plain = f"[{_ranges(marks)}]", f"[{_ranges([m for m in marks if chr(m) not in _JOINERS])}]"
        self.clusters = re.compile(
            rf"\r\n?|(?P<emoji>[{_EMOJI}]{plain}*(?:\u200d{plain}*[{_EMOJI}]{plain}*)+)|(?P<shaped>[{_SHAPED}]{plain}*[{_JOINERS}]{mark}*(?=[{_SHAPED}]))"
            rf"|[{_ranges(jamo)}]+{mark}*|[^{_ranges(marks)}]?{mark}+|[{_ranges(active)}]",
            re.DOTALL,
        )
        self.active = frozenset(map(chr, active))  # all clusters of a text without marks and line ends
        self.joining = frozenset(map(chr, [*marks, *jamo])) | {"\r"}
        transducer = self

        class Memory(dict):
            def __init__(self, keep: str):
                self.keep = keep

            def __missing__(self, cluster: str) -> str:
                out = transducer._output(cluster, self.keep)
                if len(self) < 500_000 and len(cluster) < 16:
                    self[cluster] = out
                return out

        self.memory = {None: Memory(""), "emoji": Memory("\u200d"), "shaped": Memory(_JOINERS)}
        self.words: dict[tuple[str, str], str] = {}

    def _check(self) -> None:
        for c, out in self.char.items():
            if c.isascii() and c not in "\r\r\n":
                raise ValueError(f"visible {c!r} would change")
            for x in out:
                if self.char.get(x, x) != x:
                    raise ValueError(f"{c!r} becomes {x!r}, which changes again")
                if self.char.get(unicodedata.normalize("NFD", x)[0], "?") == "":
                    raise ValueError(f"{c!r} becomes {x!r}, which vanishes")

    def _output(self, cluster: str, keep: str = "") -> str:
        if cluster in self.char and cluster[0] == "\r":
            return self.char[cluster]
        parts = unicodedata.normalize("NFD", cluster)
        get = self.char.get
        parts = "".join([c if c in keep else get(c, c) for c in parts])
        return unicodedata.normalize("NFC", parts)

    def _hard(self, letters: dict[str, int]) -> dict[str, int]:
        """Letters by the scripts that alone have them; a Latin one counts if no other script that is there for sure has its like."""
        count: dict[str, int] = {}
        for c, n in letters.items():
            base = unicodedata.normalize("NFD", c)[0]
            name = self.script.get(base)
            if name is not None and base not in self.alike:
                count[name] = count.get(name, 0) + n
        for c, n in letters.items():
            base = unicodedata.normalize("NFD", c)[0]
            if base not in self.script and base.isalpha() and not any(base in self.inverse[s] for s in count if s != "Latin"):
                count["Latin"] = count.get("Latin", 0) + n
        return count

    def _word(self, word: str, prevailing: str) -> str:
        letters = unicodedata.normalize("NFD", word)
        hard: dict[str, int] = {}
        for c in letters:
            if c in self.script and c not in self.alike:
                hard[self.script[c]] = hard.get(self.script[c], 0) + 1
        if hard:
            to = max(sorted(hard), key=hard.__getitem__)
        elif prevailing != "Latin" and all(c in self.inverse[prevailing] or self.script.get(c) == prevailing or self.alike.get(c) in self.inverse[prevailing] or not c.isalpha() for c in letters):
            to = prevailing
        else:
            to = "Latin"
        if to == "Latin":
            out = "".join([self.alike.get(c, c) for c in letters])
        else:
            back = self.inverse[to]
            stays = to if hard else None  # a word of look-alikes only has no letter of its own
            out = "".join([c if self.script.get(c, "") == stays else back.get(self.alike.get(c, c), c) for c in letters])
        return unicodedata.normalize("NFC", out)

    def _scripts(self, text: str, chars: set[str]) -> str:
        counted = Counter(text)
        hard = self._hard({c: counted[c] for c in chars if c.isalpha()})
        prevailing = max(sorted(hard, key=lambda s: s != "Latin"), key=hard.__getitem__) if hard else "Latin"
        if prevailing != "Latin" and {self.script.get(unicodedata.normalize("NFD", c)[0]) for c in chars if c.isalpha()} == {prevailing}:
            return text  # one script throughout
        words = self.words

        def word(m: re.Match) -> str:
            w = m[0]
            if prevailing == "Latin" and w.isascii():
                return w
            got = words.get((w, prevailing))
            if got is None:
                if len(words) > 300_000:
                    words.clear()
                got = words[w, prevailing] = self._word(w, prevailing)
            return got

        return _WORDS.sub(word, text)

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        chars = set(text)
        memory = self.memory
        if not chars.isdisjoint(self.joining):
            text = self.clusters.sub(lambda m: memory[m.lastgroup][m[0]], text)
            chars = set(text)
        elif found := chars & self.active:
            for c in found:
                text = text.replace(c, memory[None][c])
            chars = set(text)
        return text if chars.isdisjoint(self.script) else self._scripts(text, chars)


_COMPILED: dict = {}


def transducer(lookalikes: dict[str, str] | None = None) -> Transducer:
    """The transducer of a table, compiled once a process."""
    key = None if lookalikes is None else tuple(sorted(lookalikes.items()))
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(lookalikes)
    return _COMPILED[key]


_KEYS = "doc_id long, form binary, spelling binary"


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _keys(lookalikes: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form_of = transducer(lookalikes)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = [form_of(t) for t in texts]
            spelling = [_digest(t) for t in texts]
            form = [s if f is t or f == t else _digest(f) for f, t, s in zip(forms, texts, spelling)]
            yield pa.record_batch([batch.column(0), pa.array(form, pa.binary()), pa.array(spelling, pa.binary())], ["doc_id", "form", "spelling"])

    return run


def _forms(lookalikes: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form_of = transducer(lookalikes)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([form_of(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "form"])

    return run


def consistent(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, form``: each text in its consistent form; a null text has none and is left out."""
    return documents.filter(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _forms(confusables(documents.sparkSession)), "doc_id long, form string"
    )


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, form, spelling``: 128-bit digests of the consistent form and of the text itself, once per id.

    Null texts are left out; an empty text is like other texts without a visible character.
    """
    return (
        documents.filter(F.col(text).isNotNull() & F.col(key).isNotNull())
        .select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        .mapInArrow(_keys(confusables(documents.sparkSession)), _KEYS)
        .distinct()
    )


def alike(keys: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b`` of all documents of one form and different text, smaller id first.

    Spellings, not documents, are joined by form; copies of a text only meet when the found pairs of spellings are
    expanded, so a text with any number of copies costs no comparisons beyond the pairs that are to come out.
    """
    spellings = keys.groupBy("form", "spelling").agg(F.count("*").alias("copies"))
    several = spellings.groupBy("form").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).filter("a <> b").select("form")
    spellings = spellings.join(several, "form", "left_semi").select("form", "spelling")
    left, right = spellings.withColumnRenamed("spelling", "one"), spellings.withColumnRenamed("spelling", "two")
    pairs = left.join(right, "form").filter("one < two")
    one = keys.select("form", F.col("spelling").alias("one"), F.col("doc_id").alias("x"))
    two = keys.select("form", F.col("spelling").alias("two"), F.col("doc_id").alias("y"))
    return (
        pairs.join(one, ["form", "one"])
        .join(two, ["form", "two"])
        .filter("x <> y")
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        .distinct()
    )
