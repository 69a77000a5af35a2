"""Byte-level BPE ids of a whole corpus by prefix dynamic programming.

For every prefix of a word's bytes exactly one token can stand last in the prefix's encoding: the token whose
predecessor is the last token of the shorter prefix and forms a pair with it that BPE itself would leave apart. Keeping
that token for each prefix gives the encoding of every prefix at once, so appending is exact and costs only what is
appended, and an edit re-encodes only from the last word boundary that it cannot reach.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scale import spread

#: The word pattern of byte_bpe_50k (fixed value).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    return str(Path(os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")) / "byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id; the id is the merge's rank. Single bytes come first."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def split_pairs(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token of several bytes the two tokens that its merge joins: the two left when the lower merges are done.

    A token whose bytes no sequence of merges brings together is never reached and left out.
    """
    out = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class PrefixEncoder:
    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, tuple[int, int]]) -> None:
        self.pairs = pairs
        self.ranks = {token: rank for token, rank in ranks.items() if len(token) == 1 or rank in pairs}
        self.merged = {pair: rank for rank, pair in pairs.items()}
        self.longest = max(map(len, self.ranks), default=0)
        self.words = regex.compile(WORDS)
        self._apart: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, list[int]] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b apart: no merge across their border comes before the merges that made them.

        The merges of both are undone from the latest back. At each state the two tokens at the border must not have been
        joined, which they would have been if their merge ranks below the merge just undone.
        """
        known = self._apart.get((a, b))
        if known is None:
            x, y, undone, known = a, b, 1 << 60, True
            while True:
                if self.merged.get((x, y), 1 << 60) < undone:
                    known = False
                    break
                px, py = self.pairs.get(x), self.pairs.get(y)
                if px is None and py is None:
                    break
                # at equal rank the left one is the earlier merge, since BPE goes from the left
                if py is None or (px is not None and x > y):
                    undone, x = x, px[1]
                else:
                    undone, y = y + 1, py[0]
            if len(self._apart) < 1_000_000:
                self._apart[a, b] = known
        return known

    def extend(self, word: bytes, last: list[int], size: list[int]) -> None:
        """Bring ``last`` and ``size`` (last token of each prefix and its length) up to all prefixes of ``word``."""
        ranks, apart = self.ranks, self.apart
        for end in range(len(last) + 1, len(word) + 1):
            for length in range(min(self.longest, end), 0, -1):
                token = ranks.get(word[end - length : end])
                if token is not None and (length == end or apart(last[end - length - 1], token)):
                    last.append(token)
                    size.append(length)
                    break
            else:
                raise ValueError(f"the vocabulary lacks byte {word[end - 1]}")

    @staticmethod
    def walk(last: list[int], size: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= size[at - 1]
        return out[::-1]

    def word(self, word: str) -> list[int]:
        ids = self._memo.get(word)
        if ids is None:
            last: list[int] = []
            size: list[int] = []
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                ids = [whole]
            else:
                self.extend(raw, last, size)
                ids = self.walk(last, size)
            if len(word) <= 64 and len(self._memo) < 500_000:
                self._memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for w in self.words.findall(text):
            ids += self.word(w)
        return ids


class Prefixes:
    """A word with the last token of each of its byte prefixes; what it shares with a later form of it is not computed again."""

    def __init__(self, encoder: PrefixEncoder) -> None:
        self.encoder, self.raw, self.computed = encoder, b"", 0
        self.last: list[int] = []
        self.size: list[int] = []

    def become(self, word: str) -> list[int]:
        """The ids of ``word``; every prefix that it shares with the word before keeps its token."""
        raw = word.encode("utf-8", "surrogatepass")
        same = len(raw) if self.raw.startswith(raw) else len(self.raw) if raw.startswith(self.raw) else len(os.path.commonprefix((raw, self.raw)))
        del self.last[same:], self.size[same:]
        self.computed += len(raw) - same
        self.encoder.extend(raw, self.last, self.size)
        self.raw = raw
        return self.encoder.walk(self.last, self.size)


class EditableEncoding:
    """The ids of a text that is appended to or edited, kept by word so that an edit re-encodes only what it can reach.

    The last word, and every word of more than ``LONG`` characters, keeps its prefixes: appending to it costs what is appended, and an edit inside it
    what stands behind the edit.
    """

    LONG = 64

    def __init__(self, encoder: PrefixEncoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.parts: list[list[int]] = []
        self.prefixes: dict[int, Prefixes] = {}
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of text[start:end]; the number of words encoded again.

        Matching a word reads two characters beyond it at most (those of a contraction after an apostrophe), so words that end
        at least two characters before ``start`` stay. Behind the edit, words are taken over as soon as a new word starts where an old one did.
        """
        old_starts, old_parts, shift = self.starts, self.parts, len(new) - (end - start)
        keep = 0
        ends = [*old_starts[1:], len(self.text)]
        while keep < len(ends) and ends[keep] + 1 < start:
            keep += 1
        at = old_starts[keep] if keep < len(old_starts) else (ends[-1] if old_starts else 0)
        text = self.text[:start] + new + self.text[end:]
        behind = {s + shift: i for i, s in enumerate(old_starts) if s >= end and s + shift >= start + len(new)}
        starts, parts, again = old_starts[:keep], old_parts[:keep], 0
        held = {s: p for s, p in self.prefixes.items() if s < at}
        for m in self.encoder.words.finditer(text, at):
            if (i := behind.get(m.start())) is not None and m.start() > start + len(new):
                starts += [s + shift for s in old_starts[i:]]
                parts += old_parts[i:]
                held |= {s + shift: p for s, p in self.prefixes.items() if s >= old_starts[i]}
                break
            starts.append(m.start())
            if len(m.group()) > self.LONG or m.end() == len(text):
                held[m.start()] = p = self.prefixes.get(m.start()) or Prefixes(self.encoder)
                parts.append(p.become(m.group()))
            else:
                parts.append(self.encoder.word(m.group()))
            again += 1
        self.text, self.starts, self.parts, self.prefixes = text, starts, parts, held
        return again

    @property
    def ids(self) -> list[int]:
        return [i for part in self.parts for i in part]


_ENCODERS: dict[str, PrefixEncoder] = {}


def encode_texts(df: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, ids)`` of every row; an empty and a null text give an empty list. Repeated rows give one row each.

    The vocabulary file (of fixed size, below 1 MB) is read once on the driver and broadcast with its merge table; workers keep the
    encoder between tasks.
    """
    path = vocabulary or default_vocabulary()
    ranks = read_ranks(path)
    tables = df.sparkSession.sparkContext.broadcast((ranks, split_pairs(ranks)))
    schema = df.schema[id_column].dataType
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[schema.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path)
        if encoder is None:
            encoder = _ENCODERS[path] = PrefixEncoder(*tables.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [encoder.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(kind), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"]
                )

    rows = df.select(F.col(id_column), F.col(text).cast("string"))
    return spread(rows).mapInArrow(run, f"{id_column} {schema.simpleString()}, ids array<int>")
