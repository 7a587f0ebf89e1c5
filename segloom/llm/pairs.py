"""Broken question and answer pairs, each with its defect.

One pass reads every answer (JSON or prose) and decides what the pair alone tells: empty, nothing but the question, broken
off, in a language that the question is neither in nor asks for. It also counts the words by which answers describe:
those of elaborate answers (four sentences or strings, and more) with three different openings at least.

Refusals are told by what recurs. An answer most of whose sentences are foreign to the descriptions, having a tenth or
more of their words outside that vocabulary, gives its opening, its whole wording, its sentences and its clauses (numbers
and names of the medium masked); these are clustered by MinHash with verified Jaccard similarity, and a cluster under
three unrelated questions, whose openings are clustered likewise, is a template that reveals a refusal. No list of words
takes part in that. Fixed patterns of declining only decide what recurs too little to be revealed: an answer each of
whose sentences speaks of the conversation, and one of which declines, is a refusal too, and so are its near variants. A
pair has one defect; the first of empty, copy, refusal, truncated and language counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm import endings, languages
from segloom.llm.minhash import clusters
from segloom.llm.overlap import segment_list
from segloom.session import durable, narrowed

#: Words of an opening, and how many unrelated questions make a template of a cluster.
OPENING_WORDS, UNRELATED = 12, 3
#: Parts (sentences or JSON strings) of an elaborate answer, and the different openings under which a word describes.
ELABORATE, OPENINGS = 4, 3
#: The share of unknown words that makes a text foreign to descriptions, the words from which a sentence counts, the
#: largest share of describing sentences in a foreign answer, and the known words without which nothing is foreign.
FOREIGN, COUNTS, DESCRIBING, LEAST_KNOWN = 0.1, 3, 1 / 3, 100
_LABELS = frozenset(["emotion", "label", "source", "canonical_emotion", "emotions", "video_id", "role", "type", "id", "start", "end", "start_time", "end_time"])
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_CLAUSE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？,，、；;:：])\s*|\s[–—-]\s")
_SPACELESS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]{4}")
_MEDIA = re.compile(r"<(?:video|image|audio)>\s*")
_LEADS = frozenset(["question", "q", "prompt", "query", "user", "human", "frage", "pregunta", "hỏi"])

# Wording that declines, by language.
DECLINE = re.compile(
    r"\bi\s+(?:am\s+)?(?:can\s?not|can['’]t|won['’]t|will not|must decline|decline|refuse|have to (?:pass|decline)|would rather not|would prefer not|"
    r"prefer not|don['’]t feel comfortable|do not feel comfortable|unable|not able|not allowed|not permitted|have no access|"
    r"do(?:n['’]t| not) have access|do(?:n['’]t| not) (?:answer|comment|label|rate|judge))\b|\bi['’]m (?:not able|unable|not allowed|not permitted|afraid)\b"
    r"|\b(?:am|be) (?:not )?(?:allowed|permitted) to (?:do|judge|comment|say)|\bunable to (?:process|open|watch|help|assist|access|comply|view)"
    r"|\bi am (?:not )?(?:allowed|permitted)\b|against my (?:guidelines|rules|instructions|policy)|\bmy (?:instructions|guidelines|rules) do(?:n['’]t| not) allow"
    r"|\bpolicy i follow\b|\bnot (?:be )?(?:appropriate|possible|proper) for me\b|\bno way for me\b|\boutside (?:of )?what i (?:may|can)\b|\bbeyond what i\b"
    r"|\bno (?:timeline|labels?|answer|rating) (?:will|can) be (?:produced|given|provided)|\b(?:text-only|language) (?:assistant|model)\b"
    r"|\bnicht (?:helfen|gestattet|erlaubt|möglich|beurteilen|bewerten|beantworten)\b|\bablehnen\b|\blehne\b.*\bab\b|\bkeinen zugriff\b|\bdarf ich\b.*\bnicht\b"
    r"|\bje ne (?:peux|suis|donnerai|souhaite|dois|vais)\b|\bpas accès\b|\bm['’]est (?:impossible|interdit)|\bje (?:dois )?(?:décline|décliner|refuse)|\bpas (?:autorisé|permis)"
    r"|\bpréfère ne pas\b|\bne (?:me|m['’]) ?(?:est|permet)|\bno (?:puedo|daré|tengo acceso|me está permitido|estoy autorizad[oa]|me es posible)\b|\b(?:debo )?rechaz(?:ar|o)\b"
    r"|\bprefiero no\b|\bme niego\b|\btừ chối\b|\b(?:tôi|mình) (?:không|chưa) (?:thể|được|xem|có quyền|hỗ trợ)|\bkhông thể hỗ trợ\b|\bnằm ngoài (?:phạm vi|khả năng)"
    r"|无法|不能(?:回答|评价|提供|处理)|拒绝|没有权限|不便|не могу|не имею|отказ|нет доступа|не вправе",
    re.IGNORECASE,
)
# Words by which an answer speaks of the conversation instead of what is to be seen.
ADDRESS = re.compile(
    r"\b(?:i|me|my|mine|you|your|please)\b|\bi['’](?:m|ll|ve|d)\b|\bhuman annotator\b|\bno (?:labels?|answers?|ratings?) (?:are|is|will)\b|\bthis request\b|^(?:sorry|unfortunately|hm+|well)\b[\s,.!;:]*$"
    r"|\b(?:ich|mir|mich|mein[er]?|bitte|ihnen|leider|diese anfrage)\b|\b(?:je|j['’]|moi|m['’]|veuillez|vous|désolée?)\b|\b(?:yo|mí|usted|por favor|lo siento|esta (?:tarea|petición))\b"
    r"|\b(?:tôi|bạn|vui lòng|xin|rất tiếc|yêu cầu này)\b|[我您你请]|抱歉|对不起|\b(?:я|мне|вы|вас|пожалуйста|извините)\b",
    re.IGNORECASE,
)
# Words without one of which neither pattern can match, to spare most sentences the patterns.
_CUES = frozenset(
    (
        "i me my mine you your please annotator no labels label answers answer ratings rating request sorry unfortunately hm hmm well "
        "unable allowed permitted guidelines rules instructions policy appropriate possible proper way outside beyond timeline text only language "
        "ich mir mich mein meine meiner bitte ihnen leider anfrage nicht ablehnen lehne keinen zugriff darf je j moi m veuillez vous désolé désolée "
        "pas accès préfère yo mí usted favor siento tarea petición me debo rechazar rechazo prefiero tôi mình bạn vui lòng xin rất tiếc cầu từ chối "
        "không nằm ngoài я мне вы вас пожалуйста извините не отказ нет"
    ).split()
) | frozenset("我您你请抱对无不拒没")
# Verbs that introduce what somebody seen or heard says.
_SAYS = re.compile(
    r"\b(?:says?|said|asks?|asked|shouts?|shouted|repl(?:ies|ied)|whispers?|whispered|tells?|told|answers|answered|sagt|sagte|fragt|ruft|antwortet|dit|demande|crie|répond|dice|dijo|pregunta|grita|responde"
    r"|nói|hỏi|hét|trả lời rằng|говорит|сказала?|спрашивает|отвечает)\b|[说問问喊答]",
    re.IGNORECASE,
)
_SELF = re.compile(r"\b(?:i|we|you|ich|wir|je|j|nous|yo|tôi|mình|я|мы)\b|我", re.IGNORECASE)
# Names of the medium, a slot that refusals fill at will.
_MEDIUM = frozenset(
    "clip clips video videos vídeo vidéo footage recording film movie aufnahme ausschnitt extrait enregistrement grabación phim filmato filmpje opname gravação".split()
)
_RESULT = (
    "record_table string, record_id long, turn_no long, defect string, question string, sentences array<string>, units array<string>, "
    "cores array<string>, declines boolean, speaks boolean, word string, heads array<long>"
)
_KEY = ["record_table", "record_id", "turn_no"]


def _strings(value, out: list[str]) -> None:
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, list):
        for v in value:
            _strings(v, out)
    elif isinstance(value, dict):
        for k, v in value.items():
            if k not in _LABELS:
                _strings(v, out)


def _hollow(value) -> bool:
    """No member of a JSON value says anything."""
    if isinstance(value, dict):
        return all(_hollow(v) for v in value.values())
    if isinstance(value, list):
        return all(_hollow(v) for v in value)
    return value is None or (isinstance(value, str) and endings.blank(value))


def _no_segment(value) -> bool:
    if isinstance(value, (dict, list)) and not value:
        return True
    if isinstance(value, dict):
        for inner in (value, *(v for v in value.values() if isinstance(v, dict))):
            if "segments" in inner and not inner["segments"]:
                return True
    segments = segment_list(value)
    return _hollow(value if segments is None else segments)


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer is nothing but the question, literally, nearly, in part (most of it) or repeated."""
    if len(answer) > 60 + 2.6 * len(question) and not answer.lstrip(" \"'").lower().startswith(question[:24].lower()):
        return False  # longer than a repetition or a question with a lead, and it doesn't begin like one
    a = _WORD.findall(answer.lower())
    if not a:
        return False
    q = _WORD.findall(_MEDIA.sub("", question).lower())
    if len(a) < len(q) * 0.5 or len(q) < 2:
        return False
    if len(a) > len(q) + 4 and (len(a) % len(q) > 4 and len(q) - len(a) % len(q) > 4):
        return False
    if a[0] in _LEADS and q[0] != a[0]:
        a = a[1:]
    known = set(q)
    if sum(w in known for w in a) < 0.8 * len(a):
        return False
    times = max(1, round(len(a) / len(q)))
    target = q * times
    if a == target:
        return True
    same = sum(m.size for m in SequenceMatcher(None, target, a, autojunk=False).get_matching_blocks())
    return same >= 0.85 * max(len(a), 0.6 * len(target)) and same >= 0.55 * len(target)


def _sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.strip()) if s and _WORD.search(s)]


def masked(text: str) -> str:
    """The words of a text, numbers and names of the medium masked."""
    return _NUMBER.sub("#", " ".join("@" if w in _MEDIUM else w for w in _WORD.findall(text.lower())))


def unreported(sentence: str) -> str:
    """The sentence without what somebody in it says (``She says: I cannot help you``)."""
    for mark in (":", "："):
        lead, found, _ = sentence.partition(mark)
        if found and _SAYS.search(lead) and not _SELF.search(lead):
            return lead
    return sentence


def opening(text: str) -> str:
    return masked(" ".join(m[0] for m in islice(_WORD.finditer(text), OPENING_WORDS)))


class Vocabulary:
    """The words of elaborate answers with up to OPENINGS different openings each; ``known`` are those with as many.

    A word known to one task is known to all together, so what describes by this task's words describes for good.
    """

    def __init__(self):
        self.heads: dict[str, set[int]] = {}
        self.known = {"#", "@"}

    def unknown(self, words: set[str]) -> set[str]:
        return {w for w in words - self.known if w not in _MEDIUM and not w.isdigit()}

    def learn(self, unknown: set[str], head: str) -> None:
        at = zlib.crc32(head.encode("utf-8", "replace"))
        for w in unknown:
            heads = self.heads.setdefault(w, set())
            heads.add(at)
            if len(heads) >= OPENINGS:
                self.known.add(w)

    def describes(self, text: str) -> bool:
        words = text.split()
        return len(words) >= COUNTS and sum(w not in self.known for w in words) < FOREIGN * len(words)

    def describing(self, sentences: list[str]) -> bool:
        """Whether more than the allowed share of the sentences describes."""
        return sum(map(self.describes, sentences)) > DESCRIBING * sum(len(s.split()) >= COUNTS for s in sentences)


class Said:
    """What an answer says beyond its own defect."""

    __slots__ = ("cores", "declines", "sentences", "speaks", "units", "wording")

    def __init__(self, wording: str):
        self.wording = wording
        self.sentences = self.units = self.cores = None
        self.declines = self.speaks = False


class Judge:
    """Judges single pairs; remembers what it knows of questions and of the words of elaborate answers."""

    def __init__(self):
        self.questions: dict[str, tuple[frozenset, str | None]] = {}
        self.vocabulary = Vocabulary()

    def question(self, text: str) -> tuple[frozenset, str | None]:
        """Languages an answer may have, and the language of the question (None: unknown, then any)."""
        key = _NUMBER.sub("#", text)
        if key not in self.questions:
            if len(self.questions) > 50_000:
                self.questions.clear()
            bare = languages.unquoted(_MEDIA.sub("", text))
            own = languages.language(bare)
            self.questions[key] = (frozenset(languages.asked_for(text) | ({own} if own else set())), own)
        return self.questions[key]

    def __call__(self, question: str | None, answer: str | None) -> tuple[str | None, str | None, bool, bool]:
        """``defect`` as far as the pair tells, ``opening``, whether it declines and whether it only speaks of itself."""
        defect, said = self.judge(question, answer)
        return defect, said and opening(said.wording), bool(said and said.declines), bool(said and said.speaks)

    def judge(self, question: str | None, answer: str | None, stopped: bool | None = None) -> tuple[str | None, Said | None]:
        """The defect as far as the pair tells, and what is said, if it may be a refusal (``sentences`` is None: it describes).

        stopped: the run that made the answer was stopped; it tells where the text alone leaves open whether it ends.
        """
        if endings.blank(answer):
            return "empty", None
        r = endings.read(answer)
        parts = 1
        if r.json:
            if r.value is None:
                return ("truncated" if r.ending else None), None
            if _no_segment(r.value):
                return "empty", None
            texts: list[str] = []
            _strings(r.value, texts)
            texts = [s for s in texts if len(s) > 15 or " " in s or _SPACELESS.search(s)]
            if not texts:
                return ("truncated" if r.ending else None), None
            wording, parts = " ".join(texts), len(texts)
        else:
            wording = r.rest
        if question and is_copy(question, wording if r.json else answer):
            return "copy", None
        said = self.read(wording, parts)
        defect = None
        if r.ending or (stopped and not r.json and endings.bare(answer)):
            defect = "truncated"
        elif question:
            allowed, own = self.question(question)
            if own:
                found = languages.language(languages.unquoted(wording))
                if found and found not in allowed:
                    defect = "language"
        return defect, said

    def read(self, wording: str, parts: int) -> Said:
        said, vocabulary = Said(wording), self.vocabulary
        text = languages.unquoted(wording)
        raw: list[str] | None = None
        first = _SENTENCE.split(text.lstrip(), maxsplit=1)[0]
        if not _CUES.isdisjoint(_WORD.findall(first.lower())):
            first = unreported(first)
            if DECLINE.search(first) or ADDRESS.search(first):  # every sentence has to speak, so the first one too
                raw = _sentences(text)
                plain = [unreported(s) for s in raw]
                kinds = [bool(DECLINE.search(s)) for s in plain]
                said.speaks = bool(raw) and all(d or ADDRESS.search(s) for d, s in zip(kinds, plain))
                said.declines = said.speaks and any(kinds)
        low = wording.lower()
        unknown = vocabulary.unknown(set(_WORD.findall(low)))
        if not unknown and not said.speaks:
            return said  # nothing new, and nothing foreign
        raw = _sentences(text) if raw is None else raw
        if max(parts, len(raw)) >= ELABORATE and unknown:
            vocabulary.learn(unknown, opening(wording))
        if not said.speaks:
            # A sentence of several words without an unknown one describes; that spares most answers the closer look.
            plain = sum(s.count(" ") > COUNTS and not any(w in s for w in unknown) for s in map(str.lower, raw))
            if plain > DESCRIBING * len(raw):
                return said
        sentences = [m for s in raw if (m := masked(s))]
        if not said.speaks and vocabulary.describing(sentences):
            return said
        whole, head = masked(wording), opening(wording)
        said.sentences = sentences
        clauses = [m for c in _CLAUSE.split(text) if len((m := masked(c)).split()) >= COUNTS]
        said.units = list(dict.fromkeys([head, whole, *sentences, *clauses]))
        if said.speaks:
            core = masked(" ".join(s for d, s in zip(kinds, raw) if d) or max(raw, key=len))
            said.cores = list(dict.fromkeys(x for x in (head, whole, core) if x))
        return said


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    judge, names = Judge(), [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [
        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.string())] * 3, pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.int64())
    ]
    pack = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    words = lambda heads: [(*[None] * 8, False, False, w, sorted(h)) for w, h in heads.items()]
    for batch in batches:
        rows = []
        for key, n, turn, q, a, stopped in zip(*(batch.column(i).to_pylist() for i in range(6))):
            defect, said = judge.judge(q, a, stopped)
            if said is not None and said.sentences is not None:
                asked = None if q is None else opening(_MEDIA.sub("", q))
                rows.append((key, n, turn, defect, asked, said.sentences, said.units, said.cores or [], said.declines, said.speaks, None, None))
            elif defect is not None:
                rows.append((key, n, turn, defect, *[None] * 4, False, False, None, None))
        if rows:
            yield pack(rows)
        if len(judge.vocabulary.heads) > 300_000:
            yield pack(words(judge.vocabulary.heads))
            judge.vocabulary.heads.clear()
    if judge.vocabulary.heads:
        yield pack(words(judge.vocabulary.heads))


def conversation_pairs(records: DataFrame, name: str, key: str = "row_id") -> DataFrame:
    """``record_table, record_id, turn_no, question, answer`` of each human turn directly followed by a gpt turn."""
    c = F.col("conversations")
    steps = F.when(F.size(c) > 1, F.sequence(F.lit(1), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i: F.struct(i.cast("long").alias("n"), F.get(c, i - 1).alias("h"), F.get(c, i).alias("g"))
    rows = records.select(F.col(key).alias("record_id"), F.explode(F.transform(steps, pair)).alias("p"))
    return rows.filter((F.col("p.h.from") == "human") & (F.col("p.g.from") == "gpt")).select(
        F.lit(name).alias("record_table"), "record_id", F.col("p.n").alias("turn_no"), F.col("p.h.value").alias("question"), F.col("p.g.value").alias("answer")
    )


def judged(pairs: DataFrame) -> DataFrame:
    """What each pair alone tells, for pairs with a defect or that may be refusals, and the words that describe."""
    stopped = F.col("stopped") if "stopped" in pairs.columns else F.lit(None).cast("boolean")
    return pairs.filter("record_id is not null").select(*_KEY, "question", "answer", stopped.alias("stopped")).mapInArrow(_judge, _RESULT)


def vocabulary(read: DataFrame) -> DataFrame:
    """``word`` of all that describe: in elaborate answers of OPENINGS different openings or more."""
    heads = read.filter("word is not null").select("word", F.explode("heads").alias("head")).distinct()
    return heads.groupBy("word").count().filter(F.col("count") >= OPENINGS).select("word")


def rated(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``id, words, unknown``: the words of each text and those outside the vocabulary. texts: ``id, text``, each once."""
    n = known.count()
    words = texts.select("id", F.explode(F.split("text", " ")).alias("word")).filter("word not in ('', '#', '@')")
    counted = texts.select("id", F.size(F.split("text", " ")).alias("words"))
    if n < LEAST_KNOWN:
        return counted.withColumn("unknown", F.lit(0).cast("long"))
    unknown = narrowed(words, known, "word", how="left_anti").groupBy("id").agg(F.count("*").alias("unknown"))
    return counted.join(unknown, "id", "left").withColumn("unknown", F.coalesce("unknown", F.lit(0).cast("long")))


def candidates(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The answers that may be refusals, with ``foreign``, and each of their texts once: ``id, text, words, unknown``."""
    left = read.filter("sentences is not null")
    texts = durable(left.select(F.explode(F.array_union("sentences", F.array_union("units", "cores"))).alias("text")).distinct().withColumn("id", F.xxhash64("text")))
    rate = durable(texts.join(rated(texts, durable(vocabulary(read))), "id"))
    long_enough = F.col("words") >= COUNTS
    foreign = F.col("unknown") >= FOREIGN * F.col("words")
    marks = rate.select("id", long_enough.alias("long"), foreign.alias("odd"))
    each = left.select(*_KEY, F.explode("sentences").alias("text")).select(*_KEY, F.xxhash64("text").alias("id"))
    told = each.join(marks, "id").groupBy(*_KEY).agg(
        F.count_if("long").alias("n"), F.count_if(F.col("long") & ~F.col("odd")).alias("describing"), F.bool_and("odd").alias("all_odd")
    )
    is_foreign = (F.col("describing") <= DESCRIBING * F.col("n") + 1e-9) & ((F.col("n") > 0) | F.col("all_odd"))
    answers = left.drop("word", "heads").join(told.select(*_KEY, is_foreign.alias("foreign")), _KEY, "left")
    return durable(answers.withColumn("foreign", F.coalesce("foreign", F.lit(False))).filter("foreign or speaks")), rate


def templates(answers: DataFrame, rate: DataFrame) -> DataFrame:
    """``id, text, cluster, answers, questions, declining, foreign`` of each text, sums and distinct unrelated questions by cluster.

    Questions are unrelated if their openings (numbers masked) lie in different clusters.
    """
    text = F.explode(F.array_union("units", "cores")).alias("text")
    said = answers.select("question", "cores", F.col("declines").alias("d"), text)
    said = said.select(F.xxhash64("text").alias("id"), F.xxhash64("question").alias("asked"), (F.col("d") & F.array_contains("cores", F.col("text"))).alias("d"))
    counted = durable(said.groupBy("id", "asked").agg(F.count("*").alias("answers"), F.bool_or("d").alias("declining")))
    own = rate.join(counted.select("id").distinct(), "id", "left_semi")
    member = clusters(own.select("id", "text"))
    asked = answers.filter("question is not null").select(F.xxhash64("question").alias("id"), F.col("question").alias("text")).distinct()
    kin = clusters(asked).select(F.col("id").alias("asked"), F.col("cluster").alias("kin"))
    rows = durable(own.join(member, "id", "left").withColumn("cluster", F.coalesce("cluster", "id")))
    sums = (
        counted.join(rows.select("id", "cluster"), "id")
        .join(kin, "asked", "left")
        .groupBy("cluster")
        .agg(F.sum("answers").alias("answers"), F.countDistinct(F.coalesce("kin", "asked")).alias("questions"), F.bool_or("declining").alias("declining"))
    )
    odd = (F.col("words") > 1) & (F.col("unknown") >= FOREIGN * F.col("words"))
    return rows.withColumn("foreign", odd).select("id", "text", "cluster", "foreign").join(sums, "cluster")


def refusals(read: DataFrame, patterns: bool = True) -> DataFrame:
    """The keys of the answers that refuse; without ``patterns`` by recurrence alone."""
    answers, rate = candidates(read)
    found = durable(templates(answers, rate).select("id", (F.col("foreign") & (F.col("questions") >= UNRELATED)).alias("recurs"), (F.col("declining") | (F.col("questions") >= UNRELATED)).alias("tells")))
    hit = lambda texts, ids: narrowed(texts, durable(ids.select("id")), "id").select(*_KEY).distinct()
    each = lambda c: answers.filter("foreign" if c == "units" else "speaks").select(*_KEY, F.explode(c).alias("text")).select(*_KEY, F.xxhash64("text").alias("id"))
    revealed = hit(each("units"), found.filter("recurs"))
    if not patterns:
        return revealed
    return revealed.unionByName(hit(each("cores"), found.filter("tells"))).distinct()


def broken(pairs: DataFrame, patterns: bool = True) -> DataFrame:
    """``record_table, record_id, turn_no, defect`` of the broken pairs, once per pair.

    pairs: ``record_table, record_id, turn_no, question, answer`` and, if known, ``stopped``. A null answer is empty; a null
    question can't be copied, asks for no language and isn't counted. Without ``patterns`` refusals are told by recurrence alone.
    """
    read = durable(judged(pairs))
    refused = refusals(read, patterns).withColumn("refusal", F.lit("refusal"))
    plain = read.filter("sentences is null and word is null and defect is not null").select(*_KEY, "defect")
    told = read.filter("sentences is not null").select(*_KEY, "defect").join(refused, _KEY, "left").withColumn("defect", F.coalesce("refusal", "defect"))
    return plain.unionByName(told.select(*_KEY, "defect")).filter("defect is not null").distinct()
