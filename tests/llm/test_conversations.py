from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.llm.conversations import conversation_faults, rebuild_conversations

M = "id string, conversation_id string, role string, text string, created_at timestamp"
C = "id string, title string"
T0 = datetime(2025, 1, 1)


def faults(spark, rows, known):
    msgs = spark.createDataFrame([(i, c, r, t, None if s is None else T0 + timedelta(seconds=s)) for i, c, r, t, s in rows], M)
    return {r["conversation_id"]: r["reason"] for r in conversation_faults(msgs, spark.createDataFrame([(k, "t") for k in known], C)).collect()}


def test_reasons(spark):
    rows = [
        ("1", "ok", "User", "hi", 0), ("2", "ok", "AI", "yes", 0), ("3", "ok", "bot", "more", 1), ("4", "ok", "system", "note", 0),
        ("5", "none", "user", "N/A", 0), ("6", "none", "assistant", "...", 1), ("7", "lost", "user", "a", 0), ("8", "lost", "assistant", "b", 1),
        ("9", "late", "user", "a", None), ("10", "late", "assistant", "b", 1), ("11", "who", "user", "a", 0), ("12", "who", "?", "b", 1),
        ("13", "first", "assistant", "a", 0), ("14", "open", "user", "a", 0), ("15", "twice", "user", "a", 0), ("16", "twice", "user", "b", 1), ("17", "twice", "assistant", "c", 2),
        ("18", None, "user", "a", 0), ("1", "ok", "User", "hi", 0), ("19", "<", "user", "<no text>", 0),
    ]
    got = faults(spark, rows, ["ok", "none", "late", "who", "first", "open", "twice", "bare"])
    assert got == {"none": "empty", "lost": "broken", "late": "broken", "who": "broken", "first": "broken", "open": "missing_reply", "twice": "missing_reply", "bare": "empty", "<": "empty"}


def test_hot_conversation_over_many_partitions(spark):
    rows = [(str(i), "hot", "user" if i % 2 == 0 else "assistant", "x", i) for i in range(2000)]
    assert faults(spark, rows, ["hot"]) == {}
    rows[1001] = ("1001", "hot", "user", "x", 1001)
    assert faults(spark, rows, ["hot"]) == {"hot": "missing_reply"}


def test_random_conversations_match_a_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(40):
        turns = [rng.choice(["user", "assistant", "assistant"]) for _ in range(rng.randint(1, 6))]
        rows += [(f"{c}-{i}", f"c{c}", r, "x", i) for i, r in enumerate(turns)]
        if turns[0] != "user":
            want[f"c{c}"] = "broken"
        elif any(a == "user" and b != "assistant" for a, b in zip(turns, [*turns[1:], None], strict=True)):
            want[f"c{c}"] = "missing_reply"
    rng.shuffle(rows)
    assert faults(spark, rows, [f"c{c}" for c in range(40)]) == want


def test_rebuilt_order(spark):
    msgs = spark.createDataFrame([("b", "c", "ai", "A", T0), ("a", "c", "customer", "Q", T0), ("d", "c", "agent", "B", T0 + timedelta(seconds=2))], M)
    rows = rebuild_conversations(msgs, spark.createDataFrame([("c", "t")], C)).orderBy("turn").collect()
    assert [(r["turn"], r["speaker"], r["text"]) for r in rows] == [(1, "user", "Q"), (2, "assistant", "A"), (3, "assistant", "B")]


def test_empty_tables(spark):
    assert faults(spark, [], []) == {} and faults(spark, [], ["a"]) == {"a": "empty"}


def test_a_hot_conversation_is_spread_over_tasks(spark):
    """One conversation holds a third of all rows; no partition of the sorted turns, or of the numbered ones, is much larger than the mean."""
    from lodestone.llm import conversations as C
    from lodestone.llm import pair_defects as P

    rows = spark.range(6000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 97)).alias("conversation_id"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some text").alias("text"), F.timestamp_seconds(F.col("id")).alias("created_at"),
    )
    sizes = [r["n"] for r in P.ordered_turns(rows).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 6000 and max(sizes) < 2 * 6000 / 8
    numbered = {r["id"]: r["turn"] for r in C.numbered_turns(rows).filter("conversation_id = 'hot'").collect()}
    assert [numbered[str(i)] for i in range(0, 6000, 3)] == list(range(1, 2001))
