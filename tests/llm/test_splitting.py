from __future__ import annotations

import random
import re

from lodestone.llm.splitting import split_boundaries, split_oversized, split_text


def test_pieces_fit_keep_all_words_and_overlap():
    rng = random.Random(2)
    for _ in range(500):
        s = "".join(rng.choice(["a", "bb", "c. ", " ", "\n\n", "!", "x" * 7, "\r\n \r\n", "۔ ", " "]) for _ in range(rng.randint(0, 40)))
        pieces, _ = split_text(s, 10, 3)
        assert all(e - b <= 10 for b, e, _ in pieces)
        for before, (b, e, p) in zip(pieces, pieces[1:], strict=False):
            assert p == before[2][-3:] + s[b:e]
        if len(s) > 10:
            assert re.sub(r"\s", "", "".join(s[b:e] for b, e, _ in pieces)) == re.sub(r"\s", "", s)


def test_boundaries():
    p = "a" * 6
    assert split_text(f"{p}\n\n{p}", 10, 0)[1] == "paragraph"
    assert split_text(f"{p}.  {p}", 10, 0)[1] == "sentence"
    assert split_text(f"{p} {p}", 10, 0)[1] == "word"
    assert split_text(p * 3, 10, 0)[1] == "none"
    assert split_text(f"{p}\r\n \t\r\n{p}", 10, 0)[1] == "paragraph"
    assert split_text(f"{p}\r\n{p}", 10, 0)[1] == "word"
    assert split_text(f"  {'b' * 10}  \n\n{p}", 10, 0)[1] == "paragraph"
    assert split_text("x" * 10, 10) == ([(0, 10, "x" * 10)], None)


def test_weak_boundaries_are_merged_first():
    pieces, _ = split_text("aa. bb. cc.\n\ndd. ee.", 12, 0)
    assert [p for _, _, p in pieces] == ["aa. bb. cc.", "dd. ee."]


def test_null_empty_blank():
    assert split_text(None) == ([], None) and split_text("") == ([(0, 0, "")], None)
    assert split_text(" " * 20, 10)[0] == []


def test_operator(spark):
    rows = [("a", "w" * 5000), ("a", "w" * 5000), ("b", "short"), ("c", None), ("d", ("s" * 3000 + ". ") * 2), (None, "y" * 4001)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    assert {(r["chunk_id"], r["boundary"]) for r in split_boundaries(df).collect()} == {("a", "none"), ("d", "sentence"), (None, "none")}
    assert split_oversized(df.filter("false")).count() == 0
    big = split_oversized(spark.createDataFrame([("z", "word. " * 100_000)], "chunk_id string, text string"))
    assert big.count() >= 150 and big.selectExpr("max(end - start)").first()[0] <= 4000
