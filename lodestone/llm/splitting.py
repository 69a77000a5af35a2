"""Oversized texts cut into pieces under a limit at natural boundaries, by agglomerative merging.

A text starts as atomic segments: its paragraphs; the sentences of a paragraph that is too long; the words of such a
sentence; slices of such a word. The joins between neighbours are held in a heap, the weakest boundary first, and
neighbours are merged while their size fits.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scale import spread

#: Boundaries from strongest to weakest; a boundary's strength is its place from the end.
BOUNDARIES = ("paragraph", "sentence", "word", "none")
PARAGRAPH, SENTENCE, WORD, NONE = 3, 2, 1, 0

_EOL = "(?>\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
_BLANK_LINES = re.compile(f"{_EOL}(?:[ \t]*{_EOL})+")
_SENTENCE_END = re.compile(r"(?<=[.!?۔])\s+")
_SPACE = re.compile(r"\s+")


def _spans(pattern: re.Pattern, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The stretches of text[start:end] between the separators, without outer whitespace and without empty ones."""
    out, at = [], start
    for m in [*pattern.finditer(text, start, end), None]:
        stop = m.start() if m else end
        part = text[at:stop]
        lead = len(part) - len(part.lstrip())
        if body := len(part.strip()):
            out.append((at + lead, at + lead + body))
        at = m.end() if m else end
    return out


def atoms(text: str, limit: int) -> tuple[list[tuple[int, int, int]], int]:
    """``(start, end, boundary before it)`` of each atomic segment, and the finest boundary that had to be used."""
    out: list[tuple[int, int, int]] = []
    finest = PARAGRAPH
    for ps, pe in _spans(_BLANK_LINES, text, 0, len(text)):
        before = PARAGRAPH
        for ss, se in [(ps, pe)] if pe - ps <= limit else _spans(_SENTENCE_END, text, ps, pe):
            if (ss, se) != (ps, pe):
                finest = min(finest, SENTENCE)
            for ws, we in [(ss, se)] if se - ss <= limit else _spans(_SPACE, text, ss, se):
                if (ws, we) != (ss, se):
                    finest = min(finest, WORD)
                if we - ws > limit:
                    finest = NONE
                for at in range(ws, we, limit):
                    out.append((at, min(at + limit, we), before))
                    before = NONE
                before = WORD
            before = SENTENCE
    return out, finest


def merge(segments: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int]]:
    """Merge neighbours over the weakest boundary first, the smallest result first among equals, while it fits.

    A merged piece spans the text between its parts. Entries of the heap that name a segment merged since are dropped.
    """
    n = len(segments)
    start, end = [s[0] for s in segments], [s[1] for s in segments]
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(segments[i][2], end[i] - start[i - 1], i, i - 1) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)  # i is merged into its left neighbour j
        if not alive[i] or not alive[j] or left[i] != j or end[i] - start[j] != size or size > limit:
            continue
        alive[i] = False
        end[j], right[j] = end[i], right[i]
        if right[i] >= 0:
            k = right[i]
            left[k] = j
            heapq.heappush(heap, (segments[k][2], end[k] - start[j], k, j))
        if left[j] >= 0:
            heapq.heappush(heap, (segments[j][2], end[j] - start[left[j]], j, left[j]))
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def split_text(text: str | None, limit: int = 4000, overlap: int = 200) -> tuple[list[tuple[int, int, str]], str | None]:
    """``(start, end, piece)`` of each piece, and the finest boundary at which the text had to be cut.

    Each later piece has in front, in addition to at most ``limit`` characters of its own, the last ``overlap``
    characters of the text up to the end of the piece before. A text within the limit, empty or null has no cut: one piece as it is (none
    if null), boundary null. Whitespace at a cut is dropped; a text of whitespace only that is too long has no piece.
    """
    if text is None:
        return [], None
    if len(text) <= limit:
        return [(0, len(text), text)], None
    segments, finest = atoms(text, limit)
    pieces = []
    for n, (s, e) in enumerate(merge(segments, limit)):
        front = pieces[-1][2][-overlap:] if n and overlap else ""
        pieces.append((s, e, front + text[s:e]))
    return pieces, BOUNDARIES[PARAGRAPH - finest]


PIECES = "chunk_id string, boundary string, piece_no int, start long, end long, piece string"


def split_oversized(chunks: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """Pieces of every chunk of more than ``limit`` code points, by ``text`` alone.

    Null texts have no piece; rows repeated whole give their pieces once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for chunk_id, text in zip(pdf["chunk_id"], pdf["text"], strict=True):
                pieces, boundary = split_text(text, limit, overlap)
                rows += [(chunk_id, boundary, n, s, e, p) for n, (s, e, p) in enumerate(pieces, 1)]
            yield pd.DataFrame(rows, columns=["chunk_id", "boundary", "piece_no", "start", "end", "piece"])

    big = chunks.select("chunk_id", "text").filter(F.length("text") > limit)
    return spread(big).mapInPandas(run, PIECES).distinct()


def split_boundaries(chunks: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """``(chunk_id, boundary)`` of each oversized chunk, from its pieces."""
    return split_oversized(chunks, limit, overlap).select("chunk_id", "boundary").distinct()


def cover_of(chunks: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """``(chunk_id, whole, fits, overlaps)`` of each oversized chunk: whether its pieces, without what they share, are its text again but for
    whitespace at the cuts, none is over the limit, and each later one has the end of the piece before in front. A chunk's pieces are held together, as its text is.
    """
    big = chunks.select("chunk_id", "text").filter(F.length("text") > limit).distinct()
    pieces = split_oversized(chunks, limit, overlap)
    row = F.struct("piece_no", "piece", (F.col("end") - F.col("start")).alias("size"))
    by = pieces.groupBy("chunk_id").agg(F.sort_array(F.collect_set(row)).alias("p"))
    own = F.transform("p", lambda x: F.right(x["piece"], x["size"].cast("int")))
    later = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    front = F.transform(later, lambda x: F.left(x["piece"], (F.length(x["piece"]) - x["size"]).cast("int")))
    ends = F.transform(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: F.right(x["piece"], F.lit(overlap)))

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"(?U)\s+", "")

    checked = by.join(big, "chunk_id").select(
        "chunk_id", (bare(F.array_join(own, "")) == bare(F.col("text"))).alias("whole"), F.forall("p", lambda x: x["size"] <= limit).alias("fits"), (front == ends).alias("overlaps")
    )
    return checked.groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in ("whole", "fits", "overlaps")])
