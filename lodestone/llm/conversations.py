"""Conversations from loose message rows: secondary sort, then a finite-state automaton over the turns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scale import running_totals, without

USER_NAMES = ("user", "human", "customer", "client", "caller", "visitor", "usr", "question", "prompter")
ASSISTANT_NAMES = ("assistant", "ai", "bot", "agent", "model", "chatbot", "gpt", "assistent", "answer", "support")
SYSTEM_NAMES = ("system", "sys", "developer")
#: What stands in for a missing text, without brackets and outer punctuation, in lower case.
STAND_INS = (
    "null", "none", "nan", "nil", "na", "n/a", "undefined", "empty", "no text", "no content", "no message", "no answer",
    "missing", "blank", "nat", "void", "not available", "text missing", "empty message",
)


def speaker(role: Column) -> Column:
    """``user``, ``assistant``, ``system`` or null, however the role is spelled."""
    name = F.lower(F.regexp_replace(role, r"(?U)^[\s\p{P}]+|[\s\p{P}]+$", ""))
    return (
        F.when(name.isin(*USER_NAMES), "user")
        .when(name.isin(*ASSISTANT_NAMES), "assistant")
        .when(name.isin(*SYSTEM_NAMES), "system")
    )


def says_nothing(text: Column) -> Column:
    """Null, without letter or digit, or only a stand-in for a missing value."""
    core = F.lower(F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return text.isNull() | (core == "") | core.isin(*STAND_INS)


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row per message id, by partial aggregation: the fields of the row that is least in (time, role, text).

    Rows without an id cannot repeat and are no messages that could be named; they are left out.
    """
    known = messages.filter(F.col("id").isNotNull())
    row = F.struct(F.col("created_at").isNull().alias("late"), "created_at", "role", "conversation_id", "text")
    return known.groupBy("id").agg(F.min(row).alias("m")).select(
        "id", "m.conversation_id", "m.role", "m.text", "m.created_at"
    )


def kept_turns(messages: DataFrame) -> DataFrame:
    """Distinct messages of a conversation that say something and are no system notes, with their ``speaker``."""
    rows = distinct_messages(messages).filter(F.col("conversation_id").isNotNull())
    rows = rows.withColumn("speaker", speaker(F.col("role")))
    return rows.filter(~says_nothing(F.col("text")) & ~F.coalesce(F.col("speaker") == "system", F.lit(False)))


def turn_order(later: Column) -> list[Column]:
    """The order of turns: by time, those without one last; at equal times the user's (``later`` is 0) first, then by id."""
    return [F.col("created_at").asc_nulls_last(), later.asc(), F.col("id").asc()]


def _with_order(turns: DataFrame) -> DataFrame:
    return turns.withColumn("assistant_last", F.when(F.col("speaker") == "user", 0).otherwise(1))


FRAGMENT = "conversation_id string, part int, first string, last string, missing boolean, unclear boolean"
FRAGMENT_COLUMNS = ["conversation_id", "part", "first", "last", "missing", "unclear"]


def _automaton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The automaton over the sorted turns of one partition: a row for each conversation's stretch in it.

    Its state is the last speaker; it fails on a user's turn that no assistant's turn follows, and notes turns without time or speaker. Only the open
    stretch is held. Stretches of a conversation that goes on in the next partition are composed by :func:`conversation_faults`.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    open_: list | None = None
    for pdf in batches:
        if pdf.empty:
            continue
        conv, who = pdf["conversation_id"].to_numpy(), pdf["speaker"].to_numpy()
        n = len(conv)
        starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        bad = np.append(False, (who[:-1] == "user") & (who[1:] != "assistant"))
        bad[starts] = False
        unclear = pdf["undated"].to_numpy(dtype=bool) | (who == "?")
        missing, doubtful = np.logical_or.reduceat(bad, starts), np.logical_or.reduceat(unclear, starts)
        ends = np.append(starts[1:], n) - 1
        done = []
        for c, first, last, m, u in zip(conv[starts], who[starts], who[ends], missing.tolist(), doubtful.tolist(), strict=True):
            if open_ and open_[0] == c:
                open_[4] = open_[4] or m or (open_[3] == "user" and first != "assistant")
                open_[5] = open_[5] or u
                open_[3] = last
            else:
                if open_:
                    done.append(open_)
                open_ = [c, part, first, last, m, u]
        if done:
            yield pd.DataFrame(done, columns=FRAGMENT_COLUMNS)
    if open_:
        yield pd.DataFrame([open_], columns=FRAGMENT_COLUMNS)


def conversation_faults(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(conversation_id, reason)`` of each conversation to drop: ``empty``, ``broken`` or ``missing_reply``.

    A conversation of any length is sorted over as many partitions as its turns need; the automaton leaves one row for
    each partition, and these few rows are composed in order. Null ids are no conversations.
    """
    turns = kept_turns(messages).withColumn("speaker", F.coalesce("speaker", F.lit("?")))
    ordered = _with_order(turns).select("conversation_id", "created_at", "assistant_last", "id", "speaker")
    keys = [F.col("conversation_id"), *turn_order(F.col("assistant_last"))]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = ordered.select("conversation_id", "speaker", F.col("created_at").isNull().alias("undated")).mapInPandas(_automaton, FRAGMENT)
    stretch = F.struct("part", "first", "last", "missing")
    whole = parts.groupBy("conversation_id").agg(F.sort_array(F.collect_list(stretch)).alias("f"), F.max("unclear").alias("unclear"))
    whole = whole.select(
        "conversation_id",
        "unclear",
        F.col("f")[0]["first"].alias("opens"),
        (
            F.exists("f", lambda x: x["missing"])
            | (F.element_at("f", -1)["last"] == "user")
            | F.exists(
                F.arrays_zip(F.slice("f", 1, F.size("f") - 1).alias("a"), F.slice("f", 2, F.size("f")).alias("b")),
                lambda x: (x["a"]["last"] == "user") & (x["b"]["first"] != "assistant"),
            )
        ).alias("missing"),
    )
    known = conversations.filter(F.col("id").isNotNull()).select(F.col("id").alias("conversation_id"))
    named = messages.filter(F.col("conversation_id").isNotNull()).select("conversation_id")
    ids = known.withColumn("known", F.lit(1)).unionByName(named.withColumn("known", F.lit(0)))
    ids = ids.groupBy("conversation_id").agg((F.max("known") == 1).alias("known"))
    reason = (
        F.when(F.col("opens").isNull(), "empty")
        .when(~F.col("known") | F.col("unclear") | (F.col("opens") != "user"), "broken")
        .when(F.col("missing"), "missing_reply")
    )
    all_ = ids.join(whole, "conversation_id", "left")
    return all_.select("conversation_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def numbered_turns(messages: DataFrame) -> DataFrame:
    """The kept turns with ``turn`` (from 1) and ``asked`` (how many user's turns stand before), for any group size."""
    turns = _with_order(kept_turns(messages))
    order = turn_order(F.col("assistant_last"))
    totals = {"before": F.lit(1), "asked": F.when(F.col("speaker") == "user", 1).otherwise(0)}
    numbered = running_totals(turns, ["conversation_id"], order, totals)
    return numbered.withColumn("turn", F.col("before") + 1).drop("before", "assistant_last")


def rebuild_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(conversation_id, turn, message_id, speaker, created_at, text)``: the sound conversations in order."""
    faults = conversation_faults(messages, conversations)
    turns = without(numbered_turns(messages), faults, "conversation_id", "id")
    return turns.select("conversation_id", "turn", F.col("id").alias("message_id"), "speaker", "created_at", "text")
