"""Evaluation items that stand in corpus documents, whole or in part, by greedy string tiling.

Seeds that a document shares with an item (Karp-Rabin hashes of word runs) are grown to maximal matches. The longest unmarked match is
taken first and laid out as a tile: over single misspelt words and one short insertion, in both directions; what a tile covers is marked, and
what a mark leaves of another match waits for its turn by its own length. An item leaked into a document if a tile covers all of it or enough
of its words in a row; with a threshold of coverage also if all tiles together cover that share of it, in whatever order they stand.
A document's items are found in one pass over it.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scale import in_blocks, over_blocks, spread

#: Words in a row that make a case, the share of them that may be misspelt (one in so many), the words of an insertion at most, and the
#: length of a seed; shorter items have shorter ones (seed_size). Of 20 words in a row with two misspelt and one interruption, at least five in a row are intact.
#: A longer insertion is no short one: what stands on its two sides are two runs.
RUN, ONE_IN, INSERTED, SEED = 20, 10, 6, 5
#: Words of a case that a space may divide, beside all slips and the insertion, so that the screen (ItemIndex.candidates) lets it through.
DIVIDED = 2
#: An item in which one seed stands more often is compared with a text row by row (repeated_runs) in place of by seeds, whose pairs would be too many.
REPEATED = 64
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}\p{M}\s\x1c-\x1f\x85]+")
_ASCII_NOT_WORD = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))
_BASES = np.array([pow(0x9E3779B97F4A7C15, SEED - 1 - k, 1 << 64) for k in range(SEED)], dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    """The words between whitespace, in lower case and compatible form, without any punctuation; what has no letter or digit is none."""
    if not text:
        return []
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_NOT_WORD).decode().split()
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", text).lower()).split()


def misspelt(a: str, b: str) -> bool:
    """Whether one word is a slip of the other: one edit, or two in words of more than five letters; a swap of neighbours is one edit.

    The first or the last letter stays.
    Words with digits have no slips: another value is another value.
    """
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 3 or any(c.isdigit() for c in a + b):
        return False
    if (a[0] != b[0] and a[-1] != b[-1]) or len(set(a) ^ set(b)) > 4:
        return False
    most = 1 if max(len(a), len(b)) <= 5 else 2
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return False
        before, row = row, new
    return row[-1] <= most


def short_slip(a: str, b: str) -> bool:
    """Whether a word of one or two letters is one edit away, a swap included; some letter stays, and digits have no slips.

    So little says nothing by itself: it counts only between neighbours that match exactly.
    """
    if a == b or min(len(a), len(b)) > 2 or abs(len(a) - len(b)) > 1 or any(c.isdigit() for c in a + b):
        return False
    if len(a) == len(b):
        return len(a) == 2 and (a[0] == b[0] or a[1] == b[1] or a == b[::-1])
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


class _Numbers(dict):
    """The hash of each word, kept for the next time; of bounded size."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        n = self[word] = xxhash.xxh64_intdigest(word)
        return n


_NUMBER = _Numbers()


def _numbers(words: list[str]) -> np.ndarray:
    return np.array([_NUMBER[w] for w in words], dtype=np.uint64)


def _pairs(numbers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return numbers[:-1] * _PAIR + numbers[1:]


def seed_size(whole: int) -> int:
    """The words of a seed for an item of ``whole`` words: a run that is intact whatever slips and insertion a case has, ``SEED`` at most.

    A whole item of fewer than ``RUN`` words has one slip in ``ONE_IN`` words and one insertion, which leave that many runs and one more.
    """
    slips = whole // ONE_IN
    return min(SEED, -(-(whole - slips) // (slips + 2)))


def _seeds(numbers: np.ndarray, size: int = SEED) -> np.ndarray:
    """The rolling hash of every run of ``size`` words."""
    n = len(numbers) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n > 0 else 0):
            out += numbers[k : k + n] * _BASES[SEED - size + k]
    return out


class ItemIndex:
    """The seeds of a bounded block of items, by their size; items of fewer than ``SEED`` words go by their whole text as well."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.words = dict(items)
        self.short: dict[str, list[tuple[int, list[str]]]] = defaultdict(list)
        held: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.repeated: dict[int, np.ndarray] = {}
        self.items, needs, pairs, places, of = [], [], [], [], []
        at_all = 0
        for item, words in items:
            if 0 < len(words) < SEED:
                self.short[words[0]].append((item, words))
            if len(words) > 1 and self.words[item] is words:
                size, numbers = seed_size(len(words)), _numbers(words)
                own = _seeds(numbers, size)
                if len(own) > REPEATED and np.unique(own, return_counts=True)[1].max() > REPEATED:
                    self.repeated[item] = numbers
                else:
                    held[size] += [(int(h), item, at) for at, h in enumerate(own)]
                n = min(RUN, len(words))
                of += [len(self.items)] * (len(words) - 1)
                self.items.append(item)
                needs.append(n - 2 * (n // ONE_IN) - 2 - 2 * DIVIDED)
                pairs.append(_pairs(numbers))
                places.append(np.arange(len(words) - 1) + at_all)
                at_all += len(words) + RUN
        self.seeds = {}
        for size, rows in held.items():
            rows.sort(key=lambda r: r[0])
            self.seeds[size] = np.array([r[0] for r in rows], dtype=np.uint64), [r[1:] for r in rows]
        # neighbouring words of all items: each pair once, with the places where it stands, items lying apart from one another
        self.need = np.array(needs, dtype=np.int64)
        self.size = np.array([len(self.words[item]) for item in self.items], dtype=np.int64)
        self.always = {item for item, need in zip(self.items, needs, strict=True) if need < 1}  # so short that no pair need be left
        every = np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.pairs, self.starts = np.unique(every[order], return_index=True)
        self.starts = np.append(self.starts, len(every))
        self.places = np.concatenate(places)[order] if places else np.zeros(0, dtype=np.int64)
        self.item_at = np.full(at_all, -1, dtype=np.int64)
        if places:
            self.item_at[np.concatenate(places)] = of

    def candidates(self, numbers: np.ndarray, coverage: float | None = None) -> set[int]:
        """The items of which some run may stand in a document, by the pairs of neighbouring words that it shares with them.

        A case of ``RUN`` words has one slip in ``ONE_IN``, one insertion and ``DIVIDED`` divided words at most (or one place where two are run
        together), which cost two pairs, one and two each: of its 19 pairs at least ten stand in the document. Whole short items have fewer in
        proportion. Nothing else is left out. With ``coverage``, an item also is one if half as many of its pairs as the words to cover stand
        anywhere in the document.
        """
        if len(numbers) < 2 or not len(self.pairs):
            return self.always
        own = _pairs(numbers)
        at = np.minimum(np.searchsorted(self.pairs, own), len(self.pairs) - 1)
        at = np.unique(at[self.pairs[at] == own])
        if not len(at):
            return self.always
        n = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(n)
        where = np.sort(self.places[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - n), n)])
        near = np.searchsorted(where, where + (RUN - 1)) - np.arange(len(where))
        items = self.item_at[where]
        if coverage is not None:
            near = np.where(np.bincount(items, minlength=len(self.items))[items] >= coverage / 2 * self.size[items], RUN, near)
        return self.always | {self.items[k] for k in np.unique(items[near >= self.need[items]]).tolist()}

    def runs(self, words: list[str], numbers: np.ndarray, coverage: float | None = None) -> dict[int, list[tuple[int, int, int]]]:
        """(length, places in the document and in the item) of every maximal match of an item that repeats itself."""
        wanted = self.candidates(numbers, coverage) & self.repeated.keys() if self.repeated else ()
        return {item: repeated_runs(numbers, self.repeated[item], seed_size(len(self.words[item]))) for item in wanted}

    def matches(self, words: list[str], numbers: np.ndarray, coverage: float | None = None) -> dict[int, list[tuple[int, int]]]:
        """(place in the document, place in the item) of every seed by item."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        wanted = self.candidates(numbers, coverage)
        sizes = {seed_size(len(self.words[item])) for item in wanted}
        for size, (hashes, where) in self.seeds.items():
            if size not in sizes:
                continue
            seeds = _seeds(numbers, size)
            left = np.searchsorted(hashes, seeds, "left")
            right = np.searchsorted(hashes, seeds, "right")
            for d in np.nonzero(right > left)[0].tolist():
                for item, at in where[left[d] : right[d]]:
                    if item in wanted and self.words[item][at : at + size] == words[d : d + size]:
                        found[item].append((d, at))
        return found


def _grow(doc: list[str], item: list[str], d: int, i: int, step: int, insertion: bool) -> tuple[list[int], int]:
    """Go on from the places before which (or behind which) a match ends: 1 for each equal word of the item, 0 for a misspelt one."""
    out: list[int] = []
    while 0 <= i < len(item) and 0 <= d < len(doc):
        if item[i] == doc[d]:
            out.append(1)
            d, i = d + step, i + step
            continue
        e = d + step
        if 0 <= e < len(doc) and item[i] == (doc[d] + doc[e] if step > 0 else doc[e] + doc[d]):  # a word that a space divides
            out.append(1)
            d, i = e + step, i + step
            continue
        n = i + step
        if 0 <= n < len(item) and doc[d] == (item[i] + item[n] if step > 0 else item[n] + item[i]):  # two words run together
            out += [1, 1]
            d, i = d + step, n + step
            continue
        if misspelt(item[i], doc[d]):
            out.append(0)
            d, i = d + step, i + step
            continue
        p, q = d - step, i - step
        beside = 0 <= e < len(doc) and 0 <= n < len(item) and doc[e] == item[n] and 0 <= p < len(doc) and 0 <= q < len(item) and doc[p] == item[q]
        if beside and short_slip(item[i], doc[d]):
            out.append(0)
            d, i = d + step, i + step
            continue
        jump = 0
        if insertion:
            for gap in range(1, INSERTED + 1):
                e = d + step * gap
                if not 0 <= e < len(doc):
                    break
                if doc[e] != item[i]:
                    continue
                ahead = [(e + step * k, i + step * k) for k in (1, 2)]
                inside = [(x, y) for x, y in ahead if 0 <= x < len(doc) and 0 <= y < len(item)]
                if len(inside) == 2 and any(doc[x] == item[y] for x, y in inside) or all(doc[x] == item[y] for x, y in inside):
                    jump = gap
                    break
        if not jump:
            break
        insertion = False
        d += step * jump
    return out, d


def enough(marks: list[int], whole: int) -> bool:
    """Whether a tile is a case: all words of the item, or ``RUN`` in a row, of which one in ``ONE_IN`` may be misspelt."""
    if len(marks) >= whole and marks.count(0) <= whole // ONE_IN:
        return True
    if len(marks) < RUN:
        return False
    wrong = RUN - sum(marks[:RUN])
    if wrong <= RUN // ONE_IN:
        return True
    for k in range(RUN, len(marks)):
        wrong += marks[k - RUN] - marks[k]
        if wrong <= RUN // ONE_IN:
            return True
    return False


def repeated_runs(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, places) of all maximal runs of ``least`` words that two texts share, by one row of run lengths for each word of the document."""
    out = []
    before = np.zeros(len(item) + 1, dtype=np.int32)
    for d in range(len(doc) + 1):
        row = np.zeros(len(item) + 1, dtype=np.int32)
        if d < len(doc):
            row[1:] = np.where(item == doc[d], before[:-1] + 1, 0)
        ended = before.copy()
        ended[:-1][row[1:] > 0] = 0  # these go on
        for i in np.nonzero(ended >= least)[0].tolist():
            n = int(ended[i])
            out.append((n, d - n, i - n))
        before = row
    return out


def _unmarked(d: int, i: int, size: int, doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, places) of the parts of a match that no mark covers."""
    free = np.concatenate([[False], ~(doc[d : d + size] | item[i : i + size]), [False]])
    edges = np.flatnonzero(free[1:] != free[:-1])
    return [(b - a, d + a, i + a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def tiles(
    doc: list[str], item: list[str], seeds: list[tuple[int, int]], least: int = SEED, matches: list[tuple[int, int, int]] | None = None
) -> tuple[bool, int, int, int]:
    """(leaked, words of the item covered by its tiles, start and end of the longest tile in the document).

    The longest match is always laid next. What the marks leave of a match is laid later if it still has ``least`` words, or the words of a seed.
    Whether a tile is a case is told of all words that it grows over; marks only bound what is covered.
    """
    runs: dict[int, list[list[int]]] = defaultdict(list)
    size = seed_size(len(item))
    for d, i in sorted(seeds, key=lambda s: (s[0] - s[1], s[0])):
        on = runs[d - i]
        if on and on[-1][1] >= d:
            on[-1][1] = d + size
        else:
            on.append([d, d + size])
    waiting = [(a - b, a, a - diagonal) for diagonal, spans in runs.items() for a, b in spans]
    if matches is not None:
        waiting = [(-n, d, i) for n, d, i in matches]
    heapq.heapify(waiting)
    least = min(least, size)
    marked_doc, marked_item = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    leaked, best = False, (0, 0, 0)
    while waiting:
        length, d, i = heapq.heappop(waiting)
        if marked_doc[d : d - length].any() or marked_item[i : i - length].any():
            for part, x, y in _unmarked(d, i, -length, marked_doc, marked_item):
                if part >= least:
                    heapq.heappush(waiting, (-part, x, y))
            continue
        plain = _grow(doc, item, d - 1, i - 1, -1, False)
        for early in (False, True):
            back, start = _grow(doc, item, d - 1, i - 1, -1, True) if early else plain
            if early and len(back) == len(plain[0]):
                break  # no insertion before the match: the last tile stays the longer one
            on, end = _grow(doc, item, d - length, i - length, 1, not early)
            marks = back[::-1] + [1] * -length + on
            leaked = leaked or enough(marks, len(item))
            if len(marks) > best[0]:
                best = (len(marks), start + 1, end)
        marked_doc[max(0, start + 1) : end] = True
        marked_item[i - len(back) : i - length + len(on)] = True
    return leaked, int(marked_item.sum()), best[1], best[2]


def leaks_of(text: str | None, index: ItemIndex, coverage: float | None = None) -> list[tuple[int, int, int, int, int, bool]]:
    """``(item, covered words, words of the item, first word, end word, whether in a row)`` of each item that leaked into a text.

    With ``coverage``, an item of ``RUN`` words or more has leaked as well if its tiles, in any order, cover that share of its words.
    """
    doc = words_of(text)
    if not doc:
        return []
    out = []
    for at, w in enumerate(doc if index.short else ()):
        for item, words in index.short.get(w, ()):
            if doc[at : at + len(words)] == words:
                out.append((item, len(words), len(words), at, at + len(words), True))
    whole = {row[0] for row in out}
    numbers = _numbers(doc)
    found = [(item, seeds, None) for item, seeds in index.matches(doc, numbers, coverage).items()]
    found += [(item, [], runs) for item, runs in index.runs(doc, numbers, coverage).items()]
    for item, seeds, runs in found:
        words = index.words[item]
        if item in whole:
            continue
        leaked, covered, start, end = tiles(doc, words, seeds, matches=runs)
        if leaked or (coverage is not None and len(words) >= RUN and covered >= coverage * len(words)):
            out.append((item, covered, len(words), start, end, leaked))
    return out


LEAKS = "doc_id bigint, item_id bigint, covered int, words int, first_word int, end_word int, in_a_row boolean"


def leaked_items(documents: DataFrame, items: DataFrame, coverage: float | None = None, block: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """``(doc_id, item_id, covered, words, first_word, end_word, in_a_row)`` of every item in every document that it leaked into.

    The held-out items are the query set: they are held in blocks of at most ``block`` items and ``block_bytes`` bytes of words, or one item, each of
    which is broadcast and passed over all documents. ``coverage`` is the share of an item that its tiles must cover to be a leak in whatever order;
    without it only passages in a row count. Null and empty texts and rows without id on either side give nothing; repeated rows count once.
    """
    rows = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    texts = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")

    def over(shared: Broadcast) -> DataFrame:
        cache: dict[int, ItemIndex] = {}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if 0 not in cache:
                cache[0] = ItemIndex(shared.value)
            for pdf in batches:
                out = [(i, *leak) for i, text in zip(pdf["doc_id"], pdf["text"], strict=True) for leak in leaks_of(text, cache[0], coverage)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "covered", "words", "first_word", "end_word", "in_a_row"])

        return spread(texts).mapInPandas(run, LEAKS)

    named = ((r["item_id"], words_of(r["text"])) for r in rows.orderBy("item_id", "text").toLocalIterator())
    blocks = in_blocks((x for x in named if x[1]), block, block_bytes, lambda x: 64 * len(x[1]) + sum(map(len, x[1])))
    found = over_blocks(documents.sparkSession, blocks, over)
    return documents.sparkSession.createDataFrame([], LEAKS) if found is None else found.distinct()


def leaked_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaked_items(documents, items).select("doc_id", "item_id").distinct()
