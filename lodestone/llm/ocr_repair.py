"""Running text out of scanned pages: furniture by sequence labelling of lines, broken and misread words by the corpus's own words."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.line_model import STATES, line_model, markup_form, number_form, page_number_form
from lodestone.scale import cut_lineage

_LINES = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_HYPHENS = "-‐‑\xad¬"
_BLOCK_MARKUP = re.compile(r"</?[A-Za-z]\w*[^<>]*>$|\\(?:begin|end)\{|```|~~~|\{\||\|[-}]")
_MARKUP_FIRST = frozenset("<\\`~{|")
_EDGE = ".,;:?()[]{}\"'“”‘’«»–—…*_`<>/\\=~^"
_CODE = re.compile(r"^[A-Z]{1,8}-?\d+[A-Z]?$|^\d")
#: What recognition prints, and what stood there (fixed values). The common ones may be wrong twice in a word.
COMMON = (
    ("c", "e"), ("@", "a"), ("f", "t"), ("0", "o"), ("l", "i"), ("1", "i"), ("1", "l"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"),
    ("ri", "n"), ("5", "s"), ("$", "s"), ("cl", "d"), ("q", "g"), ("9", "g"), ("ii", "u"), ("li", "h"), ("b", "h"), ("rn", "m"), ("vv", "w"),
    ("y", "v"), ("8", "b"), ("6", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("€", "e"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ſ", "s"),
)
RARE = (
    ("e", "c"), ("t", "f"), ("i", "l"), ("n", "ri"), ("d", "cl"), ("h", "li"), ("h", "b"), ("m", "rn"), ("w", "vv"), ("v", "y"), ("u", "n"),
    ("n", "u"), ("u", "v"), ("o", "c"), ("c", "o"), ("a", "o"), ("o", "a"), ("j", "i"), ("ni", "m"), ("nn", "m"), ("in", "m"), ("iii", "m"),
)
_ORDINARY = r"^[a-z]+(?:['’-][a-z]+)*$"

PAGES = (
    "chunk_id string, digest long, states string, furniture array<struct<kind:string,piece:string>>,"
    "breaks array<struct<first:string,rest:string>>, words array<string>, word string, n long"
)
_PAGES = ["chunk_id", "digest", "states", "furniture", "breaks", "words", "word", "n"]
#: Counts of words are handed on when so many are held.
HELD = 500_000


def may_be_cut(lines: list[str]) -> bool:
    """Whether anything may have to be put together: some line stops inside a sentence before another one, and no line is block markup."""
    full = [s for x in lines if (s := x.strip())]
    return any(s[-1] not in ".!?:" for s in full[:-1]) and not any(s[0] in _MARKUP_FIRST and _BLOCK_MARKUP.match(s) for s in full)


def label_lines(text: str) -> tuple[bool, list[tuple[str, str]]]:
    """Whether a text is a scanned page, and then its lines with their states; both are the best path of the model, with no bound on the width.

    A page of which no body line stops inside a sentence has nothing to repair and is none; where no line at all does, no path is looked for.
    """
    lines = _LINES.split(text)
    if not may_be_cut(lines):
        return False, []
    kind, states = line_model().decode(lines)
    labelled = list(zip(lines, states, strict=True))
    scanned = kind == "scanned" and may_be_cut([line for line, state in labelled if state == "body"])
    return scanned, labelled if scanned else []


def furniture_of(line: str, state: str) -> str | None:
    """``pagenum`` for a line of furniture that is a number by its whole form, ``header`` for one that holds a word and no markup."""
    if state not in ("pagenum", "header"):
        return None
    if page_number_form(line) or (state == "pagenum" and number_form(line)):
        return "pagenum"
    return "header" if state == "header" and re.search(r"[^\W\d_]{2}", line) and not markup_form(line) else None


def paragraphs_of(labelled: list[tuple[str, str]]) -> list[list[str]]:
    """The body lines by paragraph: a break ends one if the line before is complete; furniture alone never does."""
    out: list[list[str]] = [[]]
    blank = furniture = False
    for line, state in labelled:
        if state == "break":
            blank = True
        elif state in ("header", "pagenum"):
            furniture = True
        else:
            s = line.strip()
            last = out[-1][-1] if out[-1] else ""
            complete = not last or last[-1] in ".!?:"
            if state == "note" or (blank and (complete or (not furniture and last[-1] not in _HYPHENS))):
                out.append([])
            out[-1].append(s)
            if state == "note":
                out.append([])
            blank = furniture = False
    return [p for p in out if p]


def core(word: str) -> str:
    return word.strip(_EDGE).lower()


def _broken(paragraph: list[str]) -> Iterator[tuple[int, str, str]]:
    """(line, first part, rest) of each word that goes on in the next line after a hyphen."""
    for i in range(len(paragraph) - 1):
        a, b = paragraph[i].split(), paragraph[i + 1].split()
        if a and b and a[-1][-1] in _HYPHENS and len(a[-1]) > 1 and a[-1][-2].isalnum() and b[0][0].isalnum():
            yield i, a[-1][:-1], b[0]


def is_ordinary(word: str) -> bool:
    """Letters of English in lower case, with apostrophes or hyphens inside."""
    return word.isascii() and (word.isalpha() or bool(_IN_ORDINARY.match(word))) and word[:1].islower()


_IN_ORDINARY = re.compile(r"[a-z]+(?:['-][a-z]+)*$")


def plain_words(text: str) -> set[str]:
    return {w for w in {core(t) for t in set(text.split())} if is_ordinary(w) or (not w.isascii() and re.match(_ORDINARY, w))}


def read_page(text: str | None) -> tuple[str | None, list, list, list]:
    """(states, furniture, breaks, words) of a scanned page, a letter for the state of each line; other pages have no states and nothing to repair."""
    if not text:
        return None, [], [], []
    scanned, labelled = label_lines(text)
    if not scanned:
        return None, [], [], []
    furniture = sorted({(kind, line.strip()) for line, s in labelled if (kind := furniture_of(line, s))})
    breaks, words = set(), set()
    for paragraph in paragraphs_of(labelled):
        tokens = [p.split() for p in paragraph]
        for i, first, rest in _broken(paragraph):
            breaks.add((core(first), core(rest)))
            tokens[i].pop()
            tokens[i + 1].pop(0)
        for t in tokens:
            words.update(core(w) for w in t if not _CODE.match(w.strip(_EDGE)))
    states = "".join(_LETTER[s] for _, s in labelled)
    return states, furniture, sorted(breaks), sorted(w for w in words if len(w) > 1 and re.search("[a-zﬁﬂ]", w))


_LETTER = {s: s[0] for s in STATES} | {"break": "-"}
_STATE = {x: s for s, x in _LETTER.items()}


def distinct_pages(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, text, digest)``: rows repeated whole count once."""
    return chunks.select("chunk_id", "text").distinct().withColumn("digest", F.xxhash64("text"))


def read_pages(pages: DataFrame) -> DataFrame:
    """For each scanned page of :func:`distinct_pages` its layout, the furniture and the words found; for all others, how many hold each word.

    A null or empty text is not scanned and holds nothing. The counts are those of a task, to be summed. A page's words that the task counts
    itself are known to be right and left out of the page's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def handed() -> list[tuple]:
            rows = [(None, None, None, None, None, None, w, n) for w, n in counts.items()]
            counts.clear()
            return rows

        for pdf in batches:
            rows: list[tuple] = []
            for i, text, digest in zip(pdf["chunk_id"], pdf["text"], pdf["digest"], strict=True):
                states, furniture, breaks, words = read_page(text)
                if states is not None:
                    words = [w for w in words if w not in counts]
                    rows.append((i, digest, states, [{"kind": k, "piece": p} for k, p in furniture], [{"first": a, "rest": b} for a, b in breaks], words, None, None))
                elif text:
                    counts.update(plain_words(text))
            if len(counts) > HELD:
                rows += handed()
            yield pd.DataFrame(rows, columns=_PAGES, dtype=object)
        yield pd.DataFrame(handed(), columns=_PAGES, dtype=object)

    return pages.mapInPandas(run, PAGES)


#: No ordinary word is longer; what is longer, such as a text without spaces, is no misread word.
LONGEST = 60


def candidates(word: str) -> dict[str, int]:
    """The words that may stand behind a misread one, with the number of misread places: one of any kind, or two common ones."""
    found: dict[str, int] = {}
    if len(word) > LONGEST:
        return found
    plain = unicodedata.normalize("NFKC", word)
    if plain != word:
        found[plain] = 1

    def replaced(w: str, kinds: tuple, start: int) -> Iterator[tuple[str, int]]:
        for seen, true in kinds:
            at = w.find(seen, start)
            while at >= 0:
                yield w[:at] + true + w[at + len(seen) :], at + len(true)
                at = w.find(seen, at + 1)

    once = list(replaced(word, COMMON, 0))
    for new, _ in [*once, *replaced(word, RARE, 0)]:
        found.setdefault(new, 1)
    for new, start in once:
        for newer, _ in replaced(new, COMMON, start):
            found.setdefault(newer, 2)
    found.pop(word, None)
    return {w: n for w, n in found.items() if re.match(_ORDINARY, w)}


def _candidates_of(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, c, n) for w in pdf["word"] for c, n in candidates(w).items()]
            yield pd.DataFrame(rows, columns=["word", "right", "places"])

    return words.mapInPandas(run, "word string, right string, places int")


def repairs(pages: DataFrame, min_chunks: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(chunk_id, kind, piece)`` of each repair, and ``(chunk_id, wrong, right)`` of each word to put right, for :func:`read_pages`.

    The words of texts that are not scanned are the vocabulary, counted over all of them; a right word must stand in at least
    ``min_chunks``. Everything is joined by word, nothing is gathered: the vocabulary may have any size.
    """
    vocabulary = pages.filter(F.col("word").isNotNull()).groupBy(F.col("word").alias("right")).agg(F.sum("n").alias("df"))
    pages = pages.filter(F.col("states").isNotNull())
    found = pages.select("chunk_id", F.explode("furniture").alias("f")).select("chunk_id", "f.kind", "f.piece")
    words = pages.select("chunk_id", F.explode("words").alias("wide"))
    words = words.withColumn("word", F.regexp_replace("wide", r"^[!|@$]+|[!|@$]+$", "")).distinct()
    breaks = pages.select("chunk_id", F.explode("breaks").alias("b")).select("chunk_id", "b.first", "b.rest").distinct()
    known = vocabulary.select(F.col("right").alias("word"), "df")
    forms = breaks.select(
        "chunk_id", "first", "rest", F.explode(F.array(F.concat("first", "rest"), F.concat_ws("-", "first", "rest"))).alias("word")
    )
    forms = forms.join(known, "word", "left")
    unsolved = forms.groupBy("chunk_id", "first", "rest").agg(F.max("df").alias("m"), F.collect_set("word").alias("words")).filter("m is null")
    unknown = words.join(known, "word", "left_anti")
    asked = unknown.select(F.col("wide").alias("word")).union(unsolved.select(F.explode("words"))).distinct()
    good = vocabulary.filter(F.col("df") >= min_chunks)
    best = F.min(F.struct("places", (-F.col("df")).alias("rare"), "right")).alias("best")
    right = _candidates_of(asked).join(good, "right").groupBy("word").agg(best).select("word", "best.right", "best.places")
    misread = unknown.select("chunk_id", F.col("wide").alias("word")).join(right, "word").select("chunk_id", "word", "right")
    # a broken word: a known form, the more frequent first; then a misread form; then the parts put together
    ranked = forms.join(right, "word", "left")
    choice = F.min(
        F.struct(
            F.when(F.col("df").isNotNull(), 0).when(F.col("right").isNotNull(), 1).otherwise(2).alias("tier"),
            F.coalesce(-F.col("df"), F.col("places").cast("long"), F.lit(0).cast("long")).alias("order"),
            F.contains(F.col("word"), F.concat("first", F.lit("-"))).alias("hyphen"),
            F.coalesce("right", "word").alias("whole"),
        )
    ).alias("c")
    joined = ranked.groupBy("chunk_id", "first", "rest").agg(choice)
    joined = joined.select("chunk_id", "first", "rest", "c.tier", "c.whole").filter(F.col("whole").rlike(_ORDINARY))
    rows = (
        found.unionByName(joined.select("chunk_id", F.lit("hyphen").alias("kind"), F.col("whole").alias("piece")))
        .unionByName(joined.filter("tier = 1").select("chunk_id", F.lit("misread").alias("kind"), F.col("whole").alias("piece")))
        .unionByName(misread.select("chunk_id", F.lit("misread").alias("kind"), F.col("right").alias("piece")))
    )
    wrong = misread.select("chunk_id", F.col("word").alias("wrong"), "right").unionByName(
        joined.select("chunk_id", F.concat_ws("-\n", "first", "rest").alias("wrong"), F.col("whole").alias("right"))
    )
    return rows.distinct(), wrong.distinct()


def scan_repairs(chunks: DataFrame) -> DataFrame:
    return repairs(cut_lineage(read_pages(distinct_pages(chunks))))[0]


def _like(right: str, seen: str) -> str:
    body = seen.strip(_EDGE)
    start = seen.find(body) if body else 0
    word = right.upper() if len(body) > 1 and body.isupper() else right[:1].upper() + right[1:] if body[:1].isupper() else right
    return seen[:start] + word + seen[start + len(body) :]


def running_text(text: str | None, states: str | None, fixes: dict[str, str]) -> list[str]:
    """The paragraphs of a scanned page with its lines' states, without furniture, with whole and right words. Texts without states give theirs as they are."""
    if not text:
        return []
    if states is None:
        return [" ".join(p.split()) for p in re.split(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*", text) if p.strip()]
    out = []
    for paragraph in paragraphs_of(list(zip(_LINES.split(text), map(_STATE.get, states), strict=True))):
        tokens = [p.split() for p in paragraph]
        for i, first, rest in _broken(paragraph):
            whole = fixes.get(f"{core(first)}-\n{core(rest)}")
            tokens[i][-1] = _like(whole, first + rest) if whole else f"{first}-{rest}"
            tokens[i + 1].pop(0)
        out.append(" ".join(_like(fixes[core(w)], w) if core(w) in fixes else w for t in tokens for w in t))
    return out


def repair_scanned(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, paragraph_no, paragraph)``: the running text of each distinct chunk, decoded once. A chunk's fixes are bounded by its own words."""
    texts = distinct_pages(chunks)
    pages = cut_lineage(read_pages(texts))
    wrong = repairs(pages)[1].groupBy("chunk_id").agg(F.map_from_entries(F.collect_set(F.struct("wrong", "right"))).alias("fixes"))
    told = pages.filter(F.col("states").isNotNull()).select("chunk_id", "digest", "states").join(wrong, "chunk_id", "left")
    rows = texts.join(told, ["chunk_id", "digest"], "left").select("chunk_id", "text", "states", "fixes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, states, fixes in zip(pdf["chunk_id"], pdf["text"], pdf["states"], pdf["fixes"], strict=True):
                parts = running_text(text, states, dict(fixes) if fixes is not None else {})
                rows += [(i, n, p) for n, p in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["chunk_id", "paragraph_no", "paragraph"])

    return rows.mapInPandas(run, "chunk_id string, paragraph_no int, paragraph string")
