"""The language of each document, or of each stretch of a mixed one: word-first backoff and a chain over sentences.

A known word is scored by its log-frequency in each language; an unseen word by its longest known character n-grams, from five
characters down to one. The sentences of a text form a chain in which a change of language has a price, so single foreign words, codes
and short scraps stay with what stands around them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scale import spread

LANGUAGES = ("en", "ur", "ur-Latn", "ar", "de", "fr", "es", "tr", "zh")
#: Spellings of the labels, in lower case with ``-`` for any separator. A region or script behind the code is cut off before.
SPELLINGS = {
    "en": ("en", "eng", "english", "englisch", "anglais"),
    "ur": ("ur", "urd", "urdu", "اردو", "ur-arab"),
    "ur-Latn": ("ur-latn", "urd-latn", "roman-urdu", "urdu-roman", "romanized-urdu", "romanised-urdu", "urdu-latin", "latin-urdu", "urdu-latn", "ur-rom", "ur-roman"),
    "ar": ("ar", "ara", "arabic", "arb", "عربي", "العربية"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "tr": ("tr", "tur", "turkish", "türkçe", "turkce"),
    "zh": ("zh", "zho", "chi", "chinese", "cmn", "mandarin", "中文", "汉语", "zh-hans", "zh-hant"),
}


def label_language(label: Column) -> Column:
    """The language that a label names, or null for a placeholder and anything unknown."""
    name = F.lower(F.regexp_replace(label, r"(?U)^[\s\p{P}]+|[\s\p{P}]+$", ""))
    name = F.regexp_replace(name, r"[\s_./()-]+", "-")
    roots = {s: lang for lang, names in SPELLINGS.items() for s in names}
    known = F.create_map(*[F.lit(x) for pair in roots.items() for x in pair])
    base = F.regexp_extract(name, r"^(\p{L}+)-", 1)
    latin = F.rlike(name, F.lit("^(ur|urd|urdu)-.*(lat|rom)|^(roman|latin|romani[sz]ed|latini[sz]ed)-(ur|urd|urdu)"))
    return F.when(latin, "ur-Latn").otherwise(F.coalesce(F.try_element_at(known, name), F.try_element_at(known, base)))


#: What ends a sentence, with its mark, and what lies between it and the next one.
_SENTENCE = regex.compile(r"([.!?۔؟…][\"'”’»)]?)\s+|([。！？]['”’」』）]?)\s*|[\r\n\x0b\x0c\x85\u2028\u2029]+")
#: A Han character each; or letters with marks and inner apostrophes, not part of a code with digits.
_TOKEN = regex.compile(r"\p{Han}|(?<![\p{N}\p{L}_])(?<!\p{N}[-.])(?<!\p{Lu}-)[\p{L}\p{M}&&[^\p{Han}]]+(?:['’][\p{L}\p{M}&&[^\p{Han}]]+)*(?![-_.]?\p{N})", regex.V1)


def sentences(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        end = m.end(m.lastindex) if m.lastindex else m.start()
        if end > at:
            out.append((at, end))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


#: The same for texts in ASCII, which the plainer engine reads faster.
_ASCII_TOKEN = re.compile(r"(?<![0-9A-Za-z_])(?<![0-9][-.])(?<![A-Z]-)[A-Za-z]+(?:'[A-Za-z]+)*(?![-_.]?[0-9])")
#: Two capitals in a row, as every word in capitals has them.
_CAPITALS = re.compile(r"[A-Z]['’]?[A-Z]")


def tokens(sentence: str) -> list[str]:
    """The words in lower case; beside words that are not in capitals, those that are count as codes and are left out."""
    words = (_ASCII_TOKEN if sentence.isascii() else _TOKEN).findall(sentence)
    if _CAPITALS.search(sentence) and not all(t.isupper() for t in words):
        words = [t for t in words if not (len(t) > 1 and t.isascii() and t.isupper())]
    return "\n".join(words).lower().replace("’", "'").split("\n") if words else []


def _grams(word: str, longest: int) -> Iterator[str]:
    w = f"^{word}$"
    for n in range(1, longest + 1):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


#: The frequency that an unseen word or n-gram has in every language, whatever the size of the language's sample.
FLOOR = 2e-6
#: The price of a change of language between two sentences, in nats; and the most by which a scrap, which ends with no sentence mark,
#: can tell two languages apart. A scrap alone never pays for a change, several in a row do.
CHANGE, SCRAP = 10.0, 7.0
_ENDED = regex.compile(r"[.!?。！？۔؟…:：][\"'”’»)\]」』）]*\s*$")


class LanguageModel:
    #: The longest n-gram, and the most nats by which a known and an unseen word can tell two languages apart.
    ORDER, KNOWN, UNSEEN = 5, 7.0, 2.5

    def __init__(self, words: dict[str, list[float]], grams: dict[str, list[float]]) -> None:
        self.words, self.grams = words, grams
        self._ids: dict[str, int] = {}
        self._rows = np.zeros((1024, len(LANGUAGES)), dtype=np.float64)

    @classmethod
    def count(cls, counts: list[Counter], max_words: int, max_grams: int) -> LanguageModel:
        """Tables of log-frequencies out of word counts by language, of bounded size."""
        gram_counts: list[Counter] = []
        for c in counts:
            g: Counter = Counter()
            for w, n in c.items():
                for x in _grams(w, cls.ORDER):
                    g[x] += n
            gram_counts.append(g)

        def table(by: list[Counter], most: int, least: int) -> dict[str, list[float]]:
            total: Counter = Counter()
            for c in by:
                total.update(dict(c.most_common(most)))
            kept = [w for w, n in total.items() if n >= least]
            sums = [sum(c.values()) + 1.0 for c in by]
            return {w: [math.log(c[w] / s + FLOOR) for c, s in zip(by, sums, strict=True)] for w in kept}

        return cls(table(counts, max_words, 3), table(gram_counts, max_grams, 2))

    @classmethod
    def fit(cls, texts: list[tuple[str, str]], rounds: int = 3, max_words: int = 30_000, max_grams: int = 60_000) -> LanguageModel:
        """Fit on (text, language) rows whose labels may be wrong or hold for a part only.

        The first tables trust the labels; each round gives every sentence to its language on the best path and counts again. Scraps that
        go with any neighbour are so counted for all languages alike and tell none apart.
        """
        spans = [sentences(text) for text, _ in texts]
        parts = [[tokens(text[a:b]) for a, b in s] for (text, _), s in zip(texts, spans, strict=True)]
        given = [LANGUAGES.index(lang) for _, lang in texts]
        assigned = [[k] * len(p) for p, k in zip(parts, given, strict=True)]
        model = None
        for _ in range(rounds + 1):
            counts = [Counter() for _ in LANGUAGES]
            for p, ks in zip(parts, assigned, strict=True):
                for words, k in zip(p, ks, strict=True):
                    counts[k].update(words)
            model = cls.count(counts, max_words, max_grams)
            assigned = [model.path(model.evidence(t, s, p)) if p else [] for (t, _), s, p in zip(texts, spans, parts, strict=True)]
        return model

    def word(self, w: str) -> list[float]:
        row, most = self.words.get(w), self.KNOWN
        if row is None:
            row, most = self._backoff(w), self.UNSEEN
        top = max(row)
        return [max(x - top, -most) for x in row]

    def _backoff(self, word: str) -> list[float]:
        """At each place the longest known n-gram that starts there; the word's score is their mean."""
        w = f"^{word}$"
        total, n = [0.0] * len(LANGUAGES), 0
        for i in range(len(w)):
            for length in range(min(self.ORDER, len(w) - i), 0, -1):
                row = self.grams.get(w[i : i + length])
                if row is not None:
                    total = [a + b for a, b in zip(total, row, strict=True)]
                    n += 1
                    break
        return [x / n for x in total] if n else total

    def scores(self, parts: list[list[str]]) -> np.ndarray:
        """The summed log-scores of each sentence by language, relative to each word's best."""
        ids, cuts, known = [], [], self._ids.get
        for words in parts:
            cuts.append(len(ids))
            found = [known(w) for w in words]
            if None not in found:
                ids += found
                continue
            for w in words:
                k = known(w)
                if k is None:
                    k = len(self._ids)
                    if k >= 400_000:
                        self._ids.clear()  # what was found before is lost with it
                        return self.scores(parts) if len(parts) < 400_000 else np.array([np.sum([self.word(x) for x in p], axis=0) if p else np.zeros(len(LANGUAGES)) for p in parts])
                    if k >= len(self._rows):
                        self._rows = np.vstack([self._rows, np.zeros_like(self._rows)])
                    self._rows[k] = self.word(w)
                    self._ids[w] = k
                ids.append(k)
        out = np.zeros((len(parts), len(LANGUAGES)))
        if ids:
            full = [i for i, words in enumerate(parts) if words]
            out[full] = np.add.reduceat(self._rows[ids], [cuts[i] for i in full], axis=0)
        return out

    @staticmethod
    def path(emit: np.ndarray, change: float = CHANGE) -> list[int]:
        """The best languages of a chain of sentences (Viterbi); where one language is best for all of them, it is that one throughout."""
        whole = int(emit.sum(axis=0).argmax())
        if (emit[:, whole] >= emit.max(axis=1)).all():
            return [whole] * len(emit)
        score, back = emit[0].copy(), []
        for row in emit[1:]:
            best = int(score.argmax())
            stay = score >= score[best] - change
            back.append(np.where(stay, np.arange(len(score)), best))
            score = np.where(stay, score, score[best] - change) + row
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        return path

    def evidence(self, text: str, spans: list[tuple[int, int]], parts: list[list[str]]) -> np.ndarray:
        emit = self.scores(parts)
        for i, (a, b) in enumerate(spans):
            if not _ENDED.search(text, max(a, b - 12), b):
                emit[i] = np.maximum(emit[i], emit[i].max() - SCRAP)
        return emit

    def segments(self, text: str | None, change: float = CHANGE) -> list[tuple[str, float, int, int]]:
        """``(language, confidence, start, end)`` of each stretch of whole sentences; none for a text without words.

        ``change`` is the price of a change of language in nats. The confidence is the stretch's probability against its best rival,
        per three words, so that it compares texts of unlike length.
        """
        if not text:
            return []
        spans = sentences(text)
        parts = [tokens(text[a:b]) for a, b in spans]
        if not any(parts):
            return []
        emit = self.evidence(text, spans, parts)
        path = self.path(emit, change)
        out = []
        i = 0
        while i < len(path):
            j = i
            while j + 1 < len(path) and path[j + 1] == path[i]:
                j += 1
            total = emit[i : j + 1].sum(axis=0)
            n = max(1.0, sum(map(len, parts[i : j + 1])) / 3)
            p = np.exp((total - total.max()) / n)
            out.append((LANGUAGES[path[i]], float(p[path[i]] / p.sum()), spans[i][0], spans[j][1]))
            i = j + 1
        return out


def training_sample(documents: DataFrame, per_language: int = 400, longest: int = 8000) -> list[tuple[str, str]]:
    """About ``per_language`` labelled texts of each language, picked by a hash of their id, of at most ``longest`` characters each.

    This bounds what the driver gets: 9 x ``per_language`` texts in expectation, cut at twice that.
    """
    rows = documents.select("doc_id", "text", label_language(F.col("lang")).alias("language"))
    rows = rows.filter(F.col("language").isNotNull() & F.length("text").between(20, longest))
    counts = {r["language"]: r["n"] for r in rows.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col("language") == language, F.lit(min(1.0, per_language / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    # ordered, so that the model does not hang on which task was first
    picked = rows.filter(place < share).orderBy(F.xxhash64("doc_id"), "text").select("text", "language").limit(2 * per_language * len(LANGUAGES))
    return [(r["text"], r["language"]) for r in picked.collect()]


SEGMENTS = "doc_id bigint, segment_no bigint, language string, confidence double, start bigint, end bigint, segments int"


def language_segments(documents: DataFrame, per_language: int = 400) -> DataFrame:
    """The segments of every document, with its given label's language as ``labelled``. Texts without words and rows without id have none.

    ``confidence`` is the language's share of the probability among all nine, tempered to three words of evidence so that it compares segments of unlike
    length: it ranks segments by how clear they are, and is no frequency of being right.
    """
    model = LanguageModel.fit(training_sample(documents, per_language))
    shared = documents.sparkSession.sparkContext.broadcast((model.words, model.grams))
    cache: dict[int, LanguageModel] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if 0 not in cache:
            cache[0] = LanguageModel(*shared.value)
        m = cache[0]
        for pdf in batches:
            rows = []
            for doc_id, text, labelled in zip(pdf["doc_id"], pdf["text"], pdf["labelled"], strict=True):
                found = m.segments(text)
                rows += [(doc_id, n, lang, c, a, b, len(found), labelled) for n, (lang, c, a, b) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "segment_no", "language", "confidence", "start", "end", "segments", "labelled"])

    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", label_language(F.col("lang")).alias("labelled"))
    return spread(rows).mapInPandas(run, SEGMENTS + ", labelled string")


def relabelled(documents: DataFrame) -> DataFrame:
    """``(doc_id, segment_no, language)`` of documents that are mixed, or whose label is missing or wrong."""
    found = language_segments(documents)
    wrong = (F.col("segments") > 1) | F.col("labelled").isNull() | (F.col("labelled") != F.col("language"))
    return found.filter(wrong).select("doc_id", "segment_no", "language").distinct()


