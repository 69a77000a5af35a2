"""Defective answers among prompt and response pairs: empty, truncated, refusal, copy, or in another language.

Refusals: the openings of the responses, with what they share with their prompt masked, are grouped by MinHash, verified and connected. A template
that recurs across unrelated prompts is a refusal if most of its answers show evidence of one: a word of limit together with a word of
speaking acts. Such evidence decides nothing for an answer alone, and a template's members follow it whatever they say. The other defects
come from checks of copying, language and termination; an open end is judged by how often its last words end a sentence anywhere in the answers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.conversations import distinct_messages, says_nothing, speaker, turn_order
from lodestone.llm.langid import LANGUAGES, LanguageModel, training_sample
from lodestone.scale import cut_lineage, spread


def ordered_turns(messages: DataFrame) -> DataFrame:
    """``(conversation_id, later, id, text, nothing)`` of the user's and the assistant's messages, sorted within the parts of a range partitioning.

    A conversation of any size is spread over its rows' range; ``later`` is 0 for the user. There are enough parts for work that is bound by CPU.
    """
    rows = distinct_messages(messages).filter(F.col("conversation_id").isNotNull())
    rows = rows.withColumn("speaker", speaker(F.col("role"))).filter(F.col("speaker").isin("user", "assistant"))
    rows = rows.select("conversation_id", "created_at", (F.col("speaker") != "user").cast("int").alias("later"), "id", "text", says_nothing(F.col("text")).alias("nothing"))
    spark = messages.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = turn_order(F.col("later"))
    keys = [F.col("conversation_id"), *order]
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conversation_id", "later", "id", "text", "nothing")


# --- what an answer says -------------------------------------------------------------------------------------------------------

#: Words that deny, limit or decline; Turkish has them as endings too, Han characters stand alone (fixed values).
_LIMITS = frozenset(
    "not cannot can't cant couldn't won't wouldn't don't doesn't didn't isn't aren't haven't mustn't shouldn't no none nothing never neither nor unable beyond outside exceed exceeds decline declines"
    " declined refuse refuses refused prevent prevents forbid forbids prohibited impossible rather refrain insufficient lack lacking afraid"
    " nicht kein keine keinen keiner keinerlei nichts unmöglich außerhalb ablehnen verweigern"
    " pas aucun aucune impossible refuse hors rien"
    " no ningún ninguna nada imposible fuera niego"
    " değil yok imkansız"
    " نہیں قاصر ناممکن انکار باہر nahi nahin nahein nai qasir namumkin inkar"
    " لا لن ليس لست لم غير يتعذر عاجز خارج 无 不 没 拒".split()
)
_LIMIT_ENDS = ("amam", "emem", "amayız", "emeyiz", "amıyorum", "emiyorum", "amıyoruz", "emiyoruz", "amadım", "emedim", "amayacağım", "emeyeceğim")
#: How words of speaking acts, of knowing and of their matter begin (fixed values); Arabic ones hold a root with what stands before it.
_ACTS = (
    "answer", "help", "assist", "advis", "advic", "comment", "discuss", "explain", "guid", "inform", "instruct", "provid", "respond", "respons", "reply", "repli", "disclos", "request", "question", "scope", "topic", "matter", "know", "certain", "sure",
    "antwort", "beantwort", "helf", "weiterhelf", "hilfe", "auskunft", "angaben", "erklär", "frage", "répon", "aid", "renseign", "conseil", "expliqu",
    "respuesta", "ayud", "aconsej", "explic", "pregunta", "contest", "yardım", "yanıt", "cevap", "bilgi", "soru",
    "جواب", "مدد", "معلومات", "مشورہ", "بتا", "سوال", "رہنمائی", "jawab", "madad", "maloomat", "mashwara", "bata", "sawal", "rehnumai",
    "答", "帮", "助", "供", "解", "论",
)
_ACT = regex.compile("^(?:" + "|".join(_ACTS) + r")|(?:جاب|جيب|ساعد|معلوم|سؤال|شرح|نصيح)")
#: Words of the speaker; where verbs tell it, the first person of being able (fixed values).
_SELF = frozenset(
    "i i'm i'd i've i'll me my myself we we're we've us our ich wir mir mich uns mein meine unser unsere je j'ai moi me m'est nous mon notre yo mi nos nuestro puedo podemos tengo dispongo estoy soy"
    " ben biz benim bizim میرے مجھے میرا ہم ہمارے سکتا سکتی سکتے سکوں ممکن mere mujhe mera hum hamare sakta sakti sakte sakoon mumkin أستطيع يمكنني أقدر بإمكاني لدي أنا نحن 我".split()
)
#: Words that open a condition: such a sentence tells what to do in a case (fixed values).
_IF = frozenset("if when unless wenn falls sobald si quand lorsque cuando eğer agar jab اگر جب إذا عندما إن 如 若 当".split())


def evidence(words: list[str]) -> int:
    """How much of a refusal the words of a sentence show: 0 none, 1 a limit with an act, 2 of the speaker as well."""
    speaks = any(w.endswith(_LIMIT_ENDS) for w in words)
    if (_LIMITS.isdisjoint(words) and not speaks) or words[0] in _IF or not any(_ACT.search(w) for w in words):
        return 0
    return 2 if speaks or not _SELF.isdisjoint(words) else 1


#: Courtesies and referrals that help nobody by themselves (fixed patterns).
_COURTESY = regex.compile(
    r"""^\W*(?:(?:i['’]m\ |i\ am\ |we['’]re\ |so\ |very\ )*sorry\b[^:;]*|sorry\ to\ hear.*|hello.*|hi\b.*|dear\b.*|thanks?\b.*|apolog(?:ies|y|ise|ize)\b[^:;]*|unfortunately|regrettably|please\ (?:contact|call|ask|refer|consult|reach|get\ in\ touch|visit|turn)\b.*
    |is\ there\ anything.*|.*\b(?:qualified|certified|trained|authori[sz]ed)\ (?:person|people|technicians?|staff|personnel|partners?)\b.*|let\ me\ know.*|feel\ free.*|good\ (?:day|morning|evening).*|as\ an?\ (?:assistant|ai)\b.*|maazrat.*|ma['’]?zrat.*|bara[ye]\ .*rabta.*|معذرت.*|عذر[اً]+.*|آسف.*|抱歉.*|对不起.*|很遗憾.*
    |tut\ mir\ leid.*|es\ tut\ mir\ leid.*|leider|bitte\ wenden.*|désolée?.*|je\ suis\ désolée?.*|malheureusement|veuillez\ contacter.*|lo\ siento.*|lamentablemente|por\ favor\ contacte.*|üzgünüm.*|maalesef.*)\W*$""",
    regex.I | regex.X | regex.V1,
)
_NUMBERED = regex.compile(r"\d")
_WORD = r"\p{Han}|[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*"
_WORDS = regex.compile(_WORD)
#: Words, and what ends a sentence: its mark, or an ellipsis or a line end, behind which it is open.
_PIECES = regex.compile(rf"{_WORD}|[.!?۔؟…][\"'”’»)]?(?=\s|$)|[。！？]|[\r\n\x0b\x0c\x85\u2028\u2029]")
_STOPS, _OPENS = frozenset(".!?۔؟。！？"), frozenset("…\r\n\x0b\x0c\x85\u2028\u2029")


def words_of(text: str) -> list[str]:
    """Words, numbers and Han characters in lower case."""
    return _WORDS.findall(text.lower().replace("’", "'"))


def sentences_of(text: str) -> list[tuple[list[str], bool]]:
    """(words in lower case, whether a mark ends it) of each sentence that has words."""
    out: list[tuple[list[str], bool]] = []
    words: list[str] = []
    for x in _PIECES.findall(text.lower().replace("’", "'")):
        if x[0] in _STOPS or x[0] in _OPENS:
            if words:
                out.append((words, x[0] in _STOPS))
                words = []
        else:
            words.append(x)
    if words:
        out.append((words, False))
    return out


def masked(words: list[str]) -> list[str]:
    return [w if w.isalpha() or not _NUMBERED.search(w) else "9" for w in words]


def opening(question: list[str], words: list[str], longest: int = 40) -> str:
    """The first words of a statement; codes and numbers, and the words that it shares with its prompt, are masked.

    Function words stay, whatever the prompt holds: words of up to three letters are never masked.
    """
    shared = {w for w in question if len(w) > 3}
    out: list[str] = []
    for w, m in zip(words[:longest], masked(words[:longest]), strict=True):
        if m != "9" and w in shared:
            m = "_"
        if m != "_" or not out or out[-1] != "_":
            out.append(m)
    return " ".join(out)


def statement(text: str, sentences: list[tuple[list[str], bool]]) -> tuple[list[str], int, bool]:
    """(words of the statement that opens an answer, the evidence in it, whether the answer holds something else).

    The statement is the first sentence that is no courtesy, or the first one of all; a colon or semicolon behind it leads to something else.
    """
    first, shown, holds = None, 0, False
    for words, _ in sentences:
        e = evidence(words)
        if e == 0 and _COURTESY.match(" ".join(words)):
            continue
        if first is None:
            first, shown = words, e
        elif e == 0:
            holds = True
            break
    if first is None:
        first = sentences[0][0] if sentences else []
    return first, shown, holds or bool(shown and _LEADS.search(text))


def shingles(text: str, size: int = 5) -> set[int]:
    w = text.split()
    return {xxhash.xxh64_intdigest(" ".join(w[i : i + size])) for i in range(max(1, len(w) - size + 1))}


#: A mark behind which an answer goes on with something else.
_LEADS = regex.compile(r"[:;：；]\s*\p{L}")

BANDS, ROWS = 12, 3
_A = np.array([(2 * xxhash.xxh64_intdigest(f"a{i}") + 1) & (2**64 - 1) for i in range(BANDS * ROWS)], dtype=np.uint64)
_B = np.array([xxhash.xxh64_intdigest(f"b{i}") for i in range(BANDS * ROWS)], dtype=np.uint64)


def bands(text: str) -> list[int]:
    """36 MinHash values in 12 bands of 3: openings of similarity 0.8 share a band with probability 0.9997."""
    s = np.fromiter(shingles(text), dtype=np.uint64)
    with np.errstate(over="ignore"):
        low = (s[:, None] * _A[None, :] + _B[None, :]).min(axis=0)
    return [xxhash.xxh64_intdigest(low[i : i + ROWS].tobytes(), seed=i) >> 1 for i in range(0, BANDS * ROWS, ROWS)]


# --- how an answer ends --------------------------------------------------------------------------------------------------------

#: Words that open or link and so end nothing (fixed values).
_LINKS = frozenset(
    "the a an and or but nor of to in on at by for with from into onto than that which who whose when while where if because since until unless although though whereas as between behind before after"
    " about above below under over through during without within otherwise then is are was were be been has have had will would can could should must may might not no its their your his her our my this these"
    " those every each see e.g i.e eg ie"
    " der die das den dem des ein eine einen einem einer und oder aber dass weil wenn mit von zu zum zur im am auf für bei nach vor über unter zwischen bevor bis ist sind muss wird werden kann soll nicht sich"
    " le la les un une des du de et ou mais que qui quand si avec pour par dans sur sous entre avant après sans est sont doit faut au aux ne pas puis ce cette"
    " el los las una uno del al y o pero que cuando si con por para en sobre entre antes después sin es son debe hay no se su lo"
    " ve veya ama ile için bir bu şu çünkü eğer gibi kadar sonra önce ki"
    " aur ya lekin ke ki ka ko se par mein jab agar to phir kyun taake warna jo is us ek"
    " اور یا لیکن کے کی کا کو سے پر میں جب اگر تو پھر تاکہ ورنہ جو اس ایک کہ"
    " و أو في من إلى على عن مع قبل بعد بين ثم إذا عندما الذي التي أن حتى لأن".split()
) - {"is", "no", "not", "hai", "under", "over", "before", "after", "below", "above", "sonra", "par", "no"}
_ENDED = regex.compile(r"[.!?。！？۔؟][\"'”’»)\]」』）*_]*$")
_OPEN = regex.compile(r"(?:[,،、;؛:：(\[{“‘–—-]|\p{Dash}|…|\.\.\.|\((?:\p{L}+\s*){1,3}|\b(?:e\.g|i\.e|z\.\ ?b|p\.\ ?ej|approx|ca|incl|esp|no|nr|fig|cf)\.)[\"'”’*_]*$", regex.I)
_DANGLING = regex.compile(r"^\s*(?:\d{1,3}[.)]|[-*•])\s*$")
_CJK_END = regex.compile(r"\p{Han}$")


def ending(text: str) -> str:
    """``done``, ``cut`` for an end that no sentence or list has, or ``open`` where the words must decide."""
    s = text.strip()
    last = s.rsplit("\n", 1)[-1]
    end = last[-200:]  # the patterns of an end look no further back
    if last is not s and _DANGLING.search(end):
        return "cut"
    if _OPEN.search(end) and any(c.isalnum() for c in s):
        return "cut"
    if _ENDED.search(end):
        return "cut" if s.count("(") > s.count(")") else "done"
    w = words_of(last)
    if not w:
        return "done"
    item = regex.match(r"\s*(?:\d{1,3}[.)]|[-*•])\s", last)
    if w[-1] in _LINKS and len(w) > 2 and not _NUMBERED.search(w[-2]):
        return "cut"
    if not item and regex.search(r"[.!?。！？۔؟][\"'”’»)]*\s+\S|[。！？]", last):
        return "cut"  # a sentence that ended stands before one that does not
    return "open"


#: Last words that end a sentence in less than this share of their other places are cut off; they need so many other places to tell.
ENDS, PLACES = 0.02, 20
#: Pieces of a word: it stands nowhere but at open ends, and at least so many longer words begin with it.
LONGER = 3


def gram(w: list[str], seed: int) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(w), seed=seed) >> 1


def tail_of(answer: str) -> list[int]:
    """Hashes of the last two words, of the last one, and of the last one as the beginning of a longer word."""
    w = masked(words_of(answer.strip().rsplit("\n", 1)[-1]))
    return [gram(w[-2:], 2) if len(w) > 1 else -1, gram(w[-1:], 1), gram(w[-1:], 0)]


#: No word has more letters; what is longer, such as a text without spaces, has no beginnings that could be told from pieces.
LONGEST = 60


class GramCounts:
    """Places of words, word pairs and beginnings of words, and how many of them end a sentence, with its mark or without."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.seen: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, sentences: list[tuple[list[str], bool]]) -> None:
        known, seen = self.words, self.seen
        for words, stop in sentences:
            seen += [known.setdefault(w, len(known)) for w in masked(words)]
            seen.append(-2 if stop else -1)

    def pack(self) -> None:
        """Count what was added since the last call: codes of a word, or of a pair, with (places, stops, open ends)."""
        a = np.array([*self.seen, -1, -1], dtype=np.int64)
        self.seen = []
        if len(a) == 2:
            return
        one, two = a[:-2] >= 0, (a[:-2] >= 0) & (a[1:-1] >= 0)
        codes = np.concatenate([a[:-2][one], (a[:-2][two] + 1 << 32) | a[1:-1][two]])
        ends = np.concatenate([a[1:-1][one], a[2:][two]])
        self._count(codes, np.stack([np.ones(len(ends), dtype=np.int64), ends == -2, ends == -1], axis=1).astype(np.int64))

    def _count(self, codes: np.ndarray, rows: np.ndarray) -> None:
        codes, at = np.unique(codes, return_inverse=True)
        out = np.zeros((len(codes), 3), dtype=np.int64)
        np.add.at(out, at, rows)
        self.parts.append((codes, out))

    def rows(self) -> list[tuple[int, int, int, int]]:
        """``(gram, places, stops, open ends)`` of all that was added, which is forgotten then."""
        self.pack()
        if not self.parts:
            return []
        codes, rows = np.concatenate([c for c, _ in self.parts]), np.concatenate([r for _, r in self.parts])
        self.parts = []
        self._count(codes, rows)
        codes, rows = self.parts.pop()
        names = list(self.words)
        out, begins = [], Counter()
        for code, (n, stops, opens) in zip(codes.tolist(), rows.tolist(), strict=True):
            if code >> 32:
                out.append((gram([names[(code >> 32) - 1], names[code & 0xFFFFFFFF]], 2), n, stops, opens))
                continue
            w = names[code]
            out.append((gram([w], 1), n, stops, opens))
            for k in range(1, min(len(w), LONGEST)):
                begins[w[:k]] += n
        self.words = {}
        return out + [(gram([w], 0), n, 0, 0) for w, n in begins.items()]

    def held(self) -> int:
        return sum(len(c) for c, _ in self.parts)


# --- the plan ------------------------------------------------------------------------------------------------------------------

_REQUESTS = {
    "en": "english|anglais|englisch|inglés|ingilizce|angrezi|انگریزی|الإنجليزية|英语|英文", "ur": "urdu|اردو|الأردية|乌尔都", "ur-Latn": "roman urdu|roman-urdu|urdu",
    "ar": "arabic|arabe|arabisch|árabe|arapça|arabi|عربی|العربية|阿拉伯", "de": "german|deutsch|allemand|alemán|almanca|jarman|جرمن|الألمانية|德语|德文",
    "fr": "french|français|francais|französisch|francés|fransızca|فرانسیسی|الفرنسية|法语|法文", "es": "spanish|español|espagnol|spanisch|ispanyolca|ہسپانوی|الإسبانية|西班牙",
    "tr": "turkish|türkçe|turc|türkisch|turco|ترکی|التركية|土耳其", "zh": "chinese|chinois|chinesisch|chino|çince|mandarin|چینی|الصينية|中文|汉语|中国话",
}
_REQUEST = {k: regex.compile(rf"(?<!\p{{L}})(?:{v})(?!\p{{L}})" if v[0].isascii() else v, regex.I) for k, v in _REQUESTS.items()}


_QUOTED = regex.compile(r"[“«\"„][^”»\"“]{1,400}[”»\"“]")


def language_words(text: str, words: list[str]) -> list[str]:
    """The words that tell a language: no codes, no numbers, nothing that is quoted."""
    if _QUOTED.search(text):
        words = words_of(_QUOTED.sub(" ", text))
    out = []
    for w in words:
        if w.isalpha():
            out.append(w)
        elif not _NUMBERED.search(w):
            out += w.split("-")
    return out


def main_language(model: LanguageModel, words: list[str], least: int = 3, margin: float = 5.0) -> tuple[str | None, set[str]]:
    """The language of a text's words, and all that come within ``margin`` nats of it; none of either for fewer than ``least`` words."""
    if len(words) < least:
        return None, set()
    total = model.scores([words])[0]
    best = int(total.argmax())
    return LANGUAGES[best], {x for x, v in zip(LANGUAGES, total, strict=True) if v >= total[best] - margin}


_LABEL = regex.compile(r"^\W*(?:q|question|you asked|your question|query|frage|pregunta|prompt|user|asked|soru|سوال|سؤال|问题|问|sawal)\s*[:：]\s*", regex.I)


def is_copy(question: str, answer: str) -> bool:
    """The answer is the question and nothing more, whatever its case, quotes, end mark or label."""
    q, a = words_of(question), words_of(_LABEL.sub("", answer))
    if not q or not a:
        return False
    if q == a or (len(a) == 2 * len(q) and a == q + q):
        return True
    if len(q) < 4 or not 0.9 <= len(a) / len(q) <= 1.15:
        return False
    same = sum(x == y for x, y in zip(q, a, strict=False))
    return same >= 0.9 * len(q) or sum(x == y for x, y in zip(q[::-1], a[::-1], strict=False)) >= 0.9 * len(q)


class PairReader:
    """What can be told of a pair by itself; it counts the words of the answers that it reads."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.counts = model, GramCounts()
        self.asked: dict[str, tuple] = {}

    def question(self, q: str) -> tuple[str | None, set[str], int, list[str]]:
        told = self.asked.get(q)
        if told is None:
            if len(self.asked) >= 20_000:
                self.asked.clear()
            words = words_of(q)
            told = self.asked[q] = (*main_language(self.model, language_words(q, words)), xxhash.xxh64_intdigest(" ".join(masked(words))) >> 1, words)
        return told

    def read(self, q: str, a: str, nothing: bool, direct: bool) -> tuple:
        """``(sure, evidence, holds, opening, prompt, tail)``; a further answer in a row, which no question stands directly before, may have any language."""
        if nothing:
            return "empty", 0, False, None, 0, None
        sentences = sentences_of(a)
        self.counts.add(sentences)
        asked, also, prompt, asking = self.question(q)
        first, shown, holds = statement(a, sentences_of(_QUOTED.sub(" ", a)) if _QUOTED.search(a) else sentences)
        sure, tail = None, None
        if len(a) <= 2 * len(q) + 60 and is_copy(q, a):
            sure = "copy"
        else:
            if direct and asked:
                lang, may = main_language(self.model, language_words(a, [w for words, _ in sentences for w in words]))
                if lang and not may & also and not _REQUEST[lang].search(q):
                    sure = "language"
            if sure is None:
                end = ending(a)
                if end == "cut":
                    sure = "truncated"
                elif end == "open":
                    tail = tail_of(a)
        return sure, shown, holds, opening(asking, first), prompt, tail


READ = (
    "kind string, id string, conversation_id string, part int, text string, flag boolean, sure string, evidence int, holds boolean, opening string, prompt long, tail array<long>,"
    " gram long, n long, stops long, opens long"
)
#: Whole numbers of 64 bits beside nulls stay as they are in columns of objects only.
_READ = [c.split()[0] for c in READ.split(", ")]
#: Counts are handed on when so many are held.
HELD = 2_000_000


def read_pairs(turns: DataFrame, model: LanguageModel) -> DataFrame:
    """One pass over the sorted turns (:func:`ordered_turns`): a row of kind ``pair`` for each answer whose question is known.

    Several answers in a row share the question before them. Where a conversation comes from the part before, answers whose question stands
    there are handed on as kind ``orphan``, and each part hands on the last question of its last conversation as kind ``carry``
    (:func:`adopted` puts both together). The counts of the words are of kind ``gram``. The rows are written once, since the parts' numbers hold in
    this one pass only.
    """
    shared = turns.sparkSession.sparkContext.broadcast((model.words, model.grams))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, reader = TaskContext.get().partitionId(), PairReader(LanguageModel(*shared.value))
        now = question = None
        begun, after = False, None  # whether the conversation begins here; whether the row before is the user's, none for the first row of all
        for pdf in batches:
            out = []
            for conv, later, i, text, nothing in zip(pdf["conversation_id"], pdf["later"], pdf["id"], pdf["text"], pdf["nothing"], strict=True):
                if conv != now:
                    begun = now is not None
                    now, question, after = conv, None, False if begun else None
                if later == 0:
                    question, after = text or "", True
                    continue
                if question is not None:
                    out.append(("pair", i, None, part, None, None, *reader.read(question, text, nothing, bool(after)), None, None, None, None))
                elif not begun:
                    out.append(("orphan", i, conv, part, text, after is None, "empty" if nothing else None, *[None] * 9))
                after = False
            reader.counts.pack()
            if reader.counts.held() > HELD:
                out += [("gram", None, None, part, *[None] * 8, *r) for r in reader.counts.rows()]
            yield pd.DataFrame(out, columns=_READ, dtype=object)
        out = [("gram", None, None, part, *[None] * 8, *r) for r in reader.counts.rows()]
        if now is not None:
            out.append(("carry", None, now, part, question, bool(after), *[None] * 10))
        yield pd.DataFrame(out, columns=_READ, dtype=object)

    return cut_lineage(turns.mapInPandas(run, READ))


def adopted(read: DataFrame, model: LanguageModel) -> DataFrame:
    """The orphans of :func:`read_pairs` with the last question of the parts before them, read as the other pairs; those without one are no pairs.

    A part has at most one carry and asks once, so a conversation over any number of parts is a short list; nothing is paired within a group.
    """
    shared = read.sparkSession.sparkContext.broadcast((model.words, model.grams))
    orphans = read.filter("kind = 'orphan'")
    asks = orphans.select("conversation_id", "part").distinct().select("*", F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("flag"), F.lit(1).alias("asks"))
    carries = read.filter("kind = 'carry'").select("conversation_id", "part", "text", "flag", F.lit(0).alias("asks"))
    before = Window.partitionBy("conversation_id").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    lists = asks.unionByName(carries).withColumns({"question": F.last("text", ignorenulls=True).over(before), "behind": F.last("flag", ignorenulls=True).over(before)})
    known = lists.filter((F.col("asks") == 1) & F.col("question").isNotNull()).select("conversation_id", "part", "question", "behind")
    rows = orphans.join(known, ["conversation_id", "part"]).select("id", "part", "question", "text", (F.col("sure") == "empty").alias("nothing"), (F.col("flag") & F.col("behind")).alias("direct"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = PairReader(LanguageModel(*shared.value))
        for pdf in batches:
            names = ["id", "part", "question", "text", "nothing", "direct"]
            out = [("pair", i, None, part, None, None, *reader.read(q, text, bool(nothing), bool(direct)), *[None] * 4) for i, part, q, text, nothing, direct in zip(*[pdf[c] for c in names], strict=True)]
            out += [("gram", None, None, None, *[None] * 8, *r) for r in reader.counts.rows()]
            yield pd.DataFrame(out, columns=_READ, dtype=object)

    return cut_lineage(rows.mapInPandas(run, READ))


def bucket_links(members: list[tuple[int, str]], similarity: float) -> list[tuple[int, int]]:
    """``(key, least key)`` of the connected components, of two members or more, of all pairs in a bucket that are similar enough.

    Two such sets share one of the rarest shingles of both (prefix filter), so only members that share one are compared, and only
    while they are not connected yet: no pair that could link two components is left out.
    """
    sets = [shingles(o) for _, o in members]
    seen = Counter(x for s in sets for x in s)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    # shingle -> members that hold it in their prefix, by the component that they were in; such a list stays in one component
    places: dict[int, dict[int, list[int]]] = {}
    for i, s in enumerate(sets):
        prefix = sorted(s, key=lambda x: (seen[x], x))[: len(s) - ceil(similarity * len(s) - 1e-9) + 1]
        for x in prefix:
            for at, others in places.get(x, {}).items():
                if find(at) != find(i):
                    met = next((j for j in others if len(s & sets[j]) >= similarity * len(s | sets[j])), None)
                    if met is not None:
                        root[find(i)] = find(met)
        for x in prefix:
            places.setdefault(x, {}).setdefault(find(i), []).append(i)
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(members):
        r = find(i)
        least[r] = min(key, least.get(r, key))
    return [(key, least[find(i)]) for i, (key, _) in enumerate(members) if key != least[find(i)]]


def components(links: DataFrame) -> DataFrame:
    """``(a, b)``: each linked key with the least key of its connected component; ``links`` has a > b.

    Rounds of joins (large and small stars), each written once, until each key has one link and that leads to a least key.
    """
    while True:
        links = cut_lineage(links.distinct())
        several = links.groupBy("a").count().filter("count > 1").select("a")
        onward = links.select(F.col("b").alias("a")).join(links.select("a").distinct(), "a", "left_semi")
        if several.unionByName(onward).isEmpty():
            return links
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = ways.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        links = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))


def refusal_templates(openings: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``(opening)``: the distinct openings of refusals, by the connected components of all verified MinHash neighbours.

    ``openings`` has a row for each answer: opening, prompt, evidence. Equal openings are counted first, so copies weigh nothing. Any two
    openings of a band's bucket that are similar enough are connected (see :func:`bucket_links`), and so are those that meet in several
    buckets; a bucket's distinct openings are held by one task. A group that stands for at least two unrelated prompts is a template, which refuses
    if most of its answers show evidence of any kind. A group of one prompt is none: it refuses only if its answers show full evidence.
    """
    distinct = openings.groupBy("opening").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("evidence") > 0).alias("some"), F.count_if(F.col("evidence") > 1).alias("full"),
        F.min("prompt").alias("low"), F.max("prompt").alias("high"),
    )
    # a short key for each opening, kept with it: the buckets carry no text
    distinct = cut_lineage(distinct.withColumn("key", F.monotonically_increasing_id()))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, b) for k, o in zip(pdf["key"], pdf["opening"], strict=True) for b in bands(o)]
            yield pd.DataFrame(rows, columns=["key", "bucket"])

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, members = None, []
        for pdf in batches:
            out = []
            for at, k, o in zip(pdf["bucket"], pdf["key"], pdf["opening"], strict=True):
                if at != bucket:
                    out += bucket_links(members, similarity)
                    bucket, members = at, []
                members.append((k, o))
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(bucket_links(members, similarity), columns=["a", "b"])

    buckets = cut_lineage(spread(distinct.select("key", "opening")).mapInPandas(hashed, "key long, bucket long"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket")
    met = buckets.join(shared, "bucket").join(distinct.select("key", "opening"), "key")
    links = components(met.repartition("bucket").sortWithinPartitions("bucket", "key").mapInPandas(linked, "a long, b long"))
    member = distinct.join(links, distinct["key"] == links["a"], "left").withColumn("group", F.coalesce("b", "key"))
    groups = member.groupBy("group").agg(
        *[F.sum(c).alias(c) for c in ("n", "some", "full")], F.min("low").alias("low"), F.max("high").alias("high")
    )
    votes = F.when(F.col("low") != F.col("high"), F.col("some")).otherwise(F.col("full"))
    return member.join(groups.filter(2 * votes > F.col("n")).select("group"), "group", "left_semi").select("opening")


def open_ends(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """``(id)`` of the answers with an open end whose last words do not end sentences elsewhere in the answers."""
    tails = pairs.filter(F.col("tail").isNotNull()).select("id", F.posexplode("tail").alias("place", "gram")).filter("gram >= 0")
    wanted = tails.select("gram").distinct()
    stats = grams.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"), F.sum("opens").alias("opens"))
    known = tails.join(stats, "gram")

    def of(place: int, column: str):  # noqa: ANN202
        return F.coalesce(F.max(F.when(F.col("place") == place, F.col(column))), F.lit(0))

    # the answer's own end is among the open ones
    each = known.groupBy("id").agg(
        of(0, "n").alias("n2"), (of(0, "stops") + of(0, "opens")).alias("e2"), of(1, "n").alias("n1"), of(1, "stops").alias("s1"),
        of(1, "opens").alias("o1"), of(2, "n").alias("longer"),
    )
    piece = (F.col("n1") == F.col("o1")) & (F.col("longer") >= LONGER)
    rare2 = (F.col("e2") - 1) < ENDS * (F.col("n2") - 1)
    rare1 = (F.col("s1") + F.col("o1") - 1) < ENDS * (F.col("n1") - 1)
    return each.filter(piece | F.when(F.col("n2") > PLACES, rare2).when(F.col("n1") > PLACES, rare1).otherwise(False)).select("id")


def defects(messages: DataFrame, documents: DataFrame, per_language: int = 400) -> DataFrame:
    """``(message_id, defect)`` of each defective answer; an answer has one defect, the first of empty, copy, refusal, language, truncated.

    ``documents`` serves to fit the language model on a bounded sample (see :func:`lodestone.llm.langid.training_sample`).
    """
    model = LanguageModel.fit(training_sample(documents, per_language))
    read = read_pairs(ordered_turns(messages), model)
    read = read.unionByName(adopted(read, model))
    pairs, grams = read.filter("kind = 'pair'"), read.filter("kind = 'gram'").select("gram", "n", "stops", "opens")
    told = pairs.filter(F.col("opening").isNotNull() & ~F.coalesce(F.col("sure") == "copy", F.lit(False)))
    refuses = refusal_templates(told.select("opening", "prompt", "evidence"))
    refusal = told.filter(~F.col("holds")).join(refuses, "opening", "left_semi").select("id", F.lit("refusal").alias("defect"))
    sure = pairs.select("id", F.col("sure").alias("defect")).filter(F.col("defect").isNotNull())
    cut = open_ends(pairs, grams).select("id", F.lit("truncated").alias("defect"))
    order = F.array_position(F.array(*[F.lit(x) for x in ("empty", "copy", "refusal", "language", "truncated")]), F.col("defect"))
    one = sure.unionByName(refusal).unionByName(cut).groupBy(F.col("id").alias("message_id")).agg(F.min(F.struct(order, "defect")).alias("d"))
    return one.select("message_id", "d.defect")
