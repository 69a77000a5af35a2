from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chat, understand


def test_roman_urdu(spark):
    df = spark.createDataFrame([("masla masla",), ("kya masla",), ("turn on the problem light",), ("",)], "t string")
    assert [r[0] for r in df.select(understand.is_roman_urdu(F.col("t"))).collect()] == [False, True, True, False]


def understood(spark, question, reply):
    df = spark.createDataFrame([(question, reply)], "q string, r string")
    return df.select(understand.understanding(F.col("q"), F.col("r")).alias("u")).first()["u"]


def test_fallback_row(spark):
    for reply in ("no json", "", "[1]", None):
        u = understood(spark, "hello", reply)
        assert (u["language"], u["confidence"], u["error_codes"], u["product_category"], u["translated_query"]) == ("Unknown", 1.0, [], None, "hello")


def test_sanitising_and_fences(spark):
    body = {"translated_query": "  ", "language": "English", "error_codes": [" e 1 ", ""], "model_names": [" ab "], "product_category": ""}
    u = understood(spark, "kya masla hai", "```json\n" + json.dumps(body) + "\n```")
    assert u["translated_query"] == "kya masla hai" and u["language"] == "Roman Urdu" and u["is_roman_urdu"]
    assert u["error_codes"] == ["E1"] and u["model_names"] == ["AB"] and u["product_category"] is None and u["confidence"] == 0.8 and u["intent"] == "general"
    assert understood(spark, "x", '{"error_codes": null}')["error_codes"] == []


def test_model_chain():
    calls = []

    def limited(_):
        calls.append("a")
        raise RuntimeError("429 quota")

    def empty_then_good(_):
        calls.append("b")
        return "" if calls.count("b") == 1 else "ok"

    waits = []
    assert understand.call_with_fallback([limited, empty_then_good], "t", sleep=waits.append) == "ok"
    assert calls == ["a", "b", "b"] and waits == [1.0]
    with pytest.raises(RuntimeError):
        understand.call_with_fallback([limited], "t", sleep=waits.append)


def test_router(spark):
    df = spark.createDataFrame([("Order warranty",), ("leave?",), ("status",), ("x",)], "t string")
    assert [r[0] for r in df.select(chat.route(F.col("t"))).collect()] == ["warranty", "leave", "order", "none"]


MESSAGES = "id string, conversation_id string, role string, text string, sources array<struct<title:string,page:int>>, is_empty boolean, created_at timestamp"


def test_titles_and_list(spark):
    msgs = spark.sql(
        "SELECT * FROM VALUES ('m2','c','assistant','a',NULL,false,TIMESTAMP'2025-01-01 00:00:02'), ('m1','c','user',repeat('x',40),NULL,false,TIMESTAMP'2025-01-01 00:00:01') t(id,conversation_id,role,text,sources,is_empty,created_at)"
    ).withColumn("sources", F.col("sources").cast("array<struct<title:string,page:int>>"))
    assert chat.first_titles(msgs).first()["title"] == "x" * 32
    conv = spark.sql("SELECT * FROM VALUES ('c','old',TIMESTAMP'2025-01-01 00:00:00',TIMESTAMP'2025-01-01 00:00:00'), ('c','new',TIMESTAMP'2025-01-01 00:00:00',TIMESTAMP'2025-01-02 00:00:00'), ('e','t',NULL,NULL) t(id,title,created_at,updated_at)")
    rows = {r["id"]: r for r in chat.listed(conv, msgs).collect()}
    assert rows["c"]["title"] == "new" and [m["id"] for m in rows["c"]["messages"]] == ["m1", "m2"] and rows["e"]["messages"] == []
    paged = chat.listed(conv, msgs, page_size=1).filter("id = 'c'").orderBy("page").collect()
    assert [(r["page"], [m["id"] for m in r["messages"]]) for r in paged] == [(1, ["m1"]), (2, ["m2"])]
    left, kept = chat.deleted(conv, msgs, conv.filter("id = 'c'"))
    assert {r["id"] for r in left.collect()} == {"e"} and kept.count() == 0


def test_feedback_last_write(spark):
    log = spark.createDataFrame([("m", "helpful", 1), ("m", "not_helpful", 2), ("m", "bogus", 3), (None, "helpful", 4)], "message_id string, feedback string, at int")
    assert [tuple(r) for r in chat.last_feedback(log).collect()] == [("m", "not_helpful")]


def test_turns_have_a_defined_order(spark):
    df = spark.createDataFrame([("c", 1, "q", "a", [], "2025-01-01")], "conversation_id string, turn int, question string, answer string, sources array<string>, at string")
    rows = chat.turn_rows(df).orderBy("seq").collect()
    assert [(r["role"], r["is_empty"]) for r in rows] == [("user", False), ("assistant", True)]
