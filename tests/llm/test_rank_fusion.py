from __future__ import annotations

import random
from datetime import datetime

from lodestone.llm.rank_fusion import borda_points, borda_ranking, borda_winner, valid_hits

HITS = "qid string, source string, chunk_id string, score double, retrieved_at timestamp"


def hits(spark, rows):
    return spark.createDataFrame([(*r, datetime(2025, 1, 1)) if len(r) == 4 else r for r in rows], HITS)


def brute(rows, weights=None):
    by = {}
    for q, s, c, v in rows:
        by.setdefault(q, {}).setdefault(s, {})[c] = v
    out = {}
    for q, sources in by.items():
        chunks = {c for s in sources.values() for c in s}
        n = len(chunks)
        for c in chunks:
            total = 0
            for s, scored in sources.items():
                k, w = len(scored), (weights or {}).get(s, 1)
                if c in scored:
                    above = sum(v > scored[c] for v in scored.values())
                    ties = sum(v == scored[c] for v in scored.values())
                    r = above + (ties + 1) / 2
                else:
                    r = (k + 1 + n) / 2
                total += w * (n - r)
            out[q, c] = total
    return out


def random_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for q in range(6):
        for s in ("exact", "vector", "bm25"):
            for c in rng.sample(range(12), rng.randint(1, 9)):
                rows.append((f"q{q}", s, f"c{c}", float(rng.choice([1, 1, 2, 3, 1e9, -4]))))
    return rows


def test_points_match_brute_force(spark):
    rows = random_rows()
    got = {(r["qid"], r["chunk_id"]): r["points"] for r in borda_points(hits(spark, rows)).collect()}
    assert got == brute(rows)
    weights = {"exact": 3, "bm25": 2}
    got = {(r["qid"], r["chunk_id"]): r["points"] for r in borda_points(hits(spark, rows), weights).collect()}
    assert got == brute(rows, weights)


def test_ranking_and_winner(spark):
    rows = random_rows(2)
    want = {}
    for (q, c), p in brute(rows).items():
        want.setdefault(q, []).append((-p, c))
    got = {}
    for r in borda_ranking(hits(spark, rows)).orderBy("qid", "position").collect():
        got.setdefault(r["qid"], []).append(r["chunk_id"])
    assert got == {q: [c for _, c in sorted(v)] for q, v in want.items()}
    assert {r["qid"]: r["chunk_id"] for r in borda_winner(hits(spark, rows)).collect()} == {q: v[0] for q, v in got.items()}


def test_ties_go_by_id(spark):
    assert borda_winner(hits(spark, [("q", "a", "y", 1.0), ("q", "a", "x", 1.0)])).first()["chunk_id"] == "x"


def test_dirty_rows(spark):
    old, new = datetime(2024, 1, 1), datetime(2025, 1, 1)
    rows = [
        ("q", "Vector ", "a", 1.0, old), ("q", "vector", "a", None, new), ("q", "vector", "b", float("nan"), new), ("q", "vector", "c", float("inf"), new),
        ("q", " VECTOR", "d", 2.0, new), ("q", "vector", "d", 2.0, new), (None, "vector", "e", 1.0, new), ("q", None, "e", 1.0, new), ("q", "vector", None, 1.0, new),
        ("q", "", "e", 1.0, new), ("q", "vector", "f", 3.0, None), ("q", "vector", "f", 4.0, old),
    ]
    got = {(r["source"], r["chunk_id"]): r["score"] for r in valid_hits(hits(spark, rows)).collect()}
    assert got == {("vector", "d"): 2.0, ("vector", "f"): 4.0}


def test_empty_table_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert borda_ranking(hits(spark, [])).count() == 0 and borda_winner(hits(spark, [])).count() == 0
    more = hits(spark, [("q", "a", "x", 1.0)]).withColumns({"rank": F.lit(9), "points": F.lit(1), "above": F.lit(0), "k": F.lit(1), "_part": F.lit(0)})
    assert borda_ranking(more).first()["position"] == 1
