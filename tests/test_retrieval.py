from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone import scale
from lodestone.operators import fuse, index, retrieve, vector_index


def lists(spark, by):
    rows = [("q", s, c, float(-i)) for s, cs in by.items() for i, c in enumerate(cs)]
    return fuse.ranked_lists(spark.createDataFrame(rows, "qid string, source string, chunk_id string, score double"))


def test_rrf_order_and_ties(spark):
    got = fuse.rrf(lists(spark, {"exact": ["a", "b"], "vector": ["b", "c", "e"], "bm25": ["c", "d"]}), top=None).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "c", "a", "d", "e"]
    assert got[0]["score"] == got[1]["score"] == 0.03252247488101534


def test_lexical_scores_match_a_loop(spark):
    rng = random.Random(3)
    docs = {f"c{i}": " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(1, 12))) for i in range(30)}
    df = spark.createDataFrame(list(docs.items()), "chunk_id string, text string")
    post, lengths = index.postings(df), index.document_lengths(df)
    terms = index.term_stats(post, lengths)
    q = spark.createDataFrame([("q", "ab ab zz kl")], "qid string, text string")
    got = {r["chunk_id"]: r["score"] for r in retrieve.lexical_scores(q, post, lengths, terms).collect()}
    tf = {k: Counter(v.split()) for k, v in docs.items()}
    df_ = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df_.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    mean = sum(sum(c.values()) for c in tf.values()) / len(docs)
    for k, c in tf.items():
        want = sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in ("ab", "ab", "kl"))
        assert abs(got.get(k, 0) - max(want, 0)) < 1e-6


def test_best_by_lexical_score_are_those_of_all_scores(spark, monkeypatch):
    rng = random.Random(4)
    names = "ab cd ef gh ij kl mn op".split()
    docs = [(f"c{i:03}", " ".join(rng.choice(names[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    df = spark.createDataFrame(docs, "chunk_id string, text string")
    post, lengths = index.postings(df), index.document_lengths(df)
    terms = index.term_stats(post, lengths)
    asked = [(f"q{i}", " ".join(rng.choice([*names, "zz"]) for _ in range(rng.randint(0, 5)))) for i in range(12)] + [("qn", None)]
    q = spark.createDataFrame(asked, "qid string, text string")
    want = [tuple(r) for r in retrieve.ranked(retrieve.lexical_scores(q, post, lengths, terms), top=7).select("qid", "chunk_id", "score", "rank").orderBy("qid", "rank").collect()]
    assert len(want) > 50
    for slab, block, size in ((400_000, 2000, 1 << 20), (5, 5, 1 << 20), (1, 1, 1), (60, 100, 300)):
        monkeypatch.setattr(retrieve, "SLAB", slab)
        got = retrieve.lexical_topk(q, post, lengths, terms, top=7, block=block, block_bytes=size).select("qid", "chunk_id", "score", "rank").orderBy("qid", "rank").collect()
        assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want], (slab, block)
        assert all(abs(x[2] - y[2]) < 1e-8 for x, y in zip(got, want, strict=True))
    assert retrieve.lexical_topk(q.filter("false"), post, lengths, terms).count() == 0


def test_questions_of_the_same_terms_are_asked_once_and_like_ones_together(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(f"c{i:03}", " ".join(rng.choice(["pump", "fan", "belt", "code", "e1", "e2", "e3"]) for _ in range(rng.randint(1, 9)))) for i in range(90)]
    df = spark.createDataFrame(docs, "chunk_id string, text string")
    post, lengths = index.postings(df), index.document_lengths(df)
    terms = index.term_stats(post, lengths)
    texts = ["pump code E1", "Code e1, pump", "pump code e2", "pump code e3", "fan fan belt", "zz", "zz pump"]
    q = spark.createDataFrame([(f"q{i:04}", texts[i % 7]) for i in range(2800)], "qid string, text string")
    blocks = []
    monkeypatch.setattr(retrieve, "over_blocks", lambda spark, given, run: scale.over_blocks(spark, (blocks.append(b) or b for b in given), run), raising=False)
    held = index.bags(df)
    assert sorted(map(tuple, index.postings_of(held).collect())) == sorted((r["term"], r["chunk_id"], r["tf"]) for r in post.collect())
    got = retrieve.lexical_topk(q, held, lengths, terms, top=4).collect()
    assert len(blocks) == 1 and len(blocks[0][0]) == 5 and sorted(len(m) for _, m in blocks[0][3]) == [1, 1, 3]
    few = q.filter("qid < 'q0007'")
    want = retrieve.ranked(retrieve.lexical_scores(few, post, lengths, terms), top=4).collect()
    by = {(r["qid"], r["rank"]): (r["chunk_id"], round(r["score"], 7)) for r in got}
    assert len(got) == 400 * len(want) and all(by[r["qid"], r["rank"]] == (r["chunk_id"], round(r["score"], 7)) for r in want)


def test_like_bags_lose_no_term():
    bags = [[(1, 1), (2, 1), (3, 2)], [(1, 1), (2, 1), (4, 1)], [(5, 1)], [(1, 1), (2, 2), (3, 2)], [(6, 1)]]
    groups = retrieve.alike(bags)
    assert {k: sorted([*shared, own]) for shared, members in groups for k, *own in members for own in [tuple(own)]} == {k: sorted(b) for k, b in enumerate(bags)}
    assert len(groups) < len(bags)


def test_exact_ranks_are_those_among_all_hits(spark):
    rng = random.Random(6)
    names = [("error_codes", "E1"), ("error_codes", "E2"), ("error_codes", "E3"), ("model_names", "PA1"), ("model_names", "E1")]
    held = spark.createDataFrame(sorted({(*rng.choice(names), f"c{rng.randint(0, 60):02}") for _ in range(150)}), "kind string, key string, chunk_id string")
    keys = [(f"q{i}", k, f" {v[0]} {v[1:].lower()}") for i in range(14) for k, v in rng.sample(names, i % 5)] + [("qx", "error_codes", " "), ("qy", "error_codes", "none")]
    keys = spark.createDataFrame(keys, "qid string, kind string, key string")
    others = spark.createDataFrame([(f"q{i}", f"c{rng.randint(0, 70):02}") for i in range(16) for _ in range(9)], "qid string, chunk_id string")
    full = {(r["qid"], r["chunk_id"]): r["rank"] for r in retrieve.ranked(retrieve.exact_hits(keys, held)).collect()}
    asked = {tuple(r) for r in others.collect()}
    got = [((r["qid"], r["chunk_id"]), r["rank"]) for r in retrieve.exact_ranks(keys, held, others, top=3).collect()]
    want = {k for k, v in full.items() if v <= 3 or k in asked}
    assert len(dict(got)) == len(got) < len(full) and want <= set(dict(got)) and all(full[k] == v for k, v in got)


def vectors(spark, n=200, dims=8):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=dims)], str(i % 7)) for i in range(n)]
    return rows, index.unit_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), "vec_id", "embedding")


def test_nearest_is_exact_in_blocks(spark):
    rows, unit = vectors(spark)
    asked = unit.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "unit")
    m = np.array([v for _, v, _ in rows], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for block in (1, 3, 100):
        got = retrieve.nearest(asked, unit, top=5, block=block).orderBy("qid", "rank").collect()
        for q in (0, 50, 100, 150):
            s = np.maximum(0, 1 - (1 - m @ m[q]) / 2)
            assert [r["vec_id"] for r in got if r["qid"] == q] == list(np.lexsort((np.arange(len(m)), -s))[:5])


def test_nearest_falls_back_without_enough_of_the_category(spark):
    _, unit = vectors(spark, 30)
    unit = unit.withColumn("label", F.when(F.col("vec_id") < 2, "rare").when(F.col("vec_id") < 20, "big").otherwise("general"))
    asked = unit.filter("vec_id in (0, 5, 25)").select(F.col("vec_id").alias("qid"), "unit", "label")
    rows = retrieve.nearest(asked, unit, top=10, category="label").collect()
    by = {q: {r["vec_id"] for r in rows if r["qid"] == q} for q in (0, 5, 25)}
    assert all(x < 20 and x >= 2 for x in by[5]) and len(by[0]) == len(by[25]) == 10


def test_nearest_of_nothing(spark):
    _, unit = vectors(spark, 5)
    assert retrieve.nearest(unit.filter("false").select(F.col("vec_id").alias("qid"), "unit"), unit).count() == 0


def test_exact_modes(spark):
    idx = spark.createDataFrame([("model_names", "DELTA ONE", "c1"), ("error_codes", "E1", "c2")], "kind string, key string, chunk_id string")
    keys = spark.createDataFrame([("q", "model_names", "delta one"), ("q", "error_codes", "e 1")], "qid string, kind string, key string")
    assert {r["chunk_id"] for r in retrieve.exact_hits(keys, idx).collect()} == {"c2"}
    assert {r["chunk_id"] for r in retrieve.exact_hits(keys, idx, "normalized").collect()} == {"c1", "c2"}


def test_rerank_keeps_fused_order_on_ties(spark):
    meta = "struct<title:string,product_category:string,page_start:int>"
    rows = [("q", "zzz", i, f"c{i}", "same text", ("t", "general", i)) for i in range(1, 8)]
    df = spark.createDataFrame(rows, f"qid string, question string, fused_rank int, chunk_id string, text string, metadata {meta}")
    assert [r["chunk_id"] for r in fuse.rerank(df).orderBy("rank").collect()] == ["c1", "c2", "c3", "c4", "c5"]
    plain = fuse.rerank(df, scorer=None).orderBy("rank").collect()
    assert [r["source"] for r in plain] == ["rrf"] * 5 and plain[0]["score"] == 0.0
    ctx = fuse.context(fuse.rerank(df)).first()["context"]
    assert ctx.startswith("--- CHUNK [c1] (Page 1, Section: t) ---\nsame text\n\n--- CHUNK [c2]")


def test_no_python_in_lexical_plan(spark):
    df = spark.createDataFrame([("c", "a b")], "chunk_id string, text string")
    post, lengths = index.postings(df), index.document_lengths(df)
    q = spark.createDataFrame([("q", "a")], "qid string, text string")
    plan = retrieve.lexical_scores(q, post, lengths, index.term_stats(post, lengths))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in middles[i % 20] + 0.5 * rng.normal(size=16)]) for i in range(2000)]
    unit = index.unit_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    centres = vector_index.fit(unit, 16, sample=1000)
    table = vector_index.build(unit, centres)
    assert table.count() == 2000 and centres.probes <= 6
    asked = unit.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "unit")
    exact = {(r["qid"], r["vec_id"]) for r in retrieve.nearest(asked, unit, top=10).collect()}
    found = {(r["qid"], r["vec_id"]) for r in vector_index.search(asked, table, centres, top=10, block=7).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    everything = {(r["qid"], r["vec_id"]) for r in vector_index.search(asked, table, centres, probes=16, top=10).collect()}
    assert everything == exact
    assert vector_index.search(asked.filter("false"), table, centres, 2).count() == 0


def test_inverted_file_on_the_given_vectors(spark):
    """They are hardly clustered: the fitted probes keep the recall, by more cells."""
    unit = index.unit_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding")
    centres = vector_index.fit(unit)
    asked = unit.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "unit")
    exact = {(r["qid"], r["vec_id"]) for r in retrieve.nearest(asked, unit).collect()}
    found = {(r["qid"], r["vec_id"]) for r in vector_index.search(asked, vector_index.build(unit, centres), centres).collect()}
    assert len(exact & found) / len(exact) >= 0.9 and centres.probes < 0.65 * len(centres.units)


def test_long_vectors_are_searched_in_blocks_of_bounded_bytes(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4100)]) for i in range(5)]
    unit = index.unit_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    asked = unit.select(F.col("vec_id").alias("qid"), "unit")
    for size in (1, 2 * 8 * 4100, 64 << 20):
        got = retrieve.nearest(asked, unit, top=1, block_bytes=size).collect()
        assert sorted((r["qid"], r["vec_id"]) for r in got) == [(i, i) for i in range(5)]
