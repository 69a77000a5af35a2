from __future__ import annotations

import random
from pathlib import Path

import pytest

from lodestone.llm.encoding import EditableEncoding, PrefixEncoder, default_vocabulary, encode_texts, read_ranks, split_pairs

if not Path(default_vocabulary()).exists():
    pytest.skip("no vocabulary files", allow_module_level=True)


@pytest.fixture(scope="module")
def encoder():
    ranks = read_ranks(default_vocabulary())
    return PrefixEncoder(ranks, split_pairs(ranks))


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(Path(default_vocabulary()).with_name("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_equals_the_library(encoder, reference):
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|>", "don't WE'LL 3.14 x", "é漢字😀", "a" * 3000, "\r\n\t  x", "日本語。", "پانی کا"]
    texts += ["".join(rng.choice("abcdeeet  in'sth\n\t-=_é漢😀́٣") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        assert encoder.encode(t) == reference(t), t


def test_edits_equal_a_new_encoding(encoder):
    rng = random.Random(7)
    for _ in range(1500):
        s = "".join(rng.choice("ab c'sll \n1") for _ in range(rng.randint(0, 30)))
        e = EditableEncoding(encoder, s)
        for _ in range(3):
            i = rng.randint(0, len(e.text))
            j = rng.randint(i, len(e.text))
            new = "".join(rng.choice("ab c'sll \n1") for _ in range(rng.randint(0, 5)))
            want = e.text[:i] + new + e.text[j:]
            e.replace(i, j, new)
            assert e.text == want and e.ids == encoder.encode(want)


def test_an_edit_touches_few_words(encoder):
    e = EditableEncoding(encoder, "some words " * 5000)
    assert e.replace(20_000, 20_003, "xyz") < 8
    before = len(e.parts)
    e.append("tail end")
    assert len(e.parts) >= before and e.ids == encoder.encode(e.text)


def test_appending_to_a_word_computes_what_is_appended(encoder):
    e = EditableEncoding(encoder, "see " + "ab" * 4000)
    p = e.prefixes[3]
    before = p.computed
    for piece in ("c", "dé", "漢"):
        e.append(piece)
        assert e.ids == encoder.encode(e.text)
    assert e.prefixes[3] is p and p.computed - before == len("cdé漢".encode())
    e.replace(5000, 5001, "Q")
    assert e.ids == encoder.encode(e.text) and p.computed - before < 3100 + 20


def test_tokens_that_no_merge_reaches_are_not_used():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"xyz": 257}
    pairs = split_pairs(ranks)
    encoder = PrefixEncoder(ranks, pairs)
    assert 257 not in pairs and encoder.word("ab") == [256] and encoder.word("xyz") == [120, 121, 122] and encoder.word("xyzab") == [120, 121, 122, 256]


def test_operator(spark, encoder):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (4, "x" * 100_000)], "doc_id long, text string")
    rows = encode_texts(df).collect()
    by = {r["doc_id"]: r["ids"] for r in rows}
    assert len(rows) == 5 and by[1] == by[2] == [] and by[3] == encoder.encode("hello world") and by[4] == encoder.encode("x" * 100_000)
    assert encode_texts(df.filter("false")).count() == 0
