"""Conversations and their messages as tables: an append-only log and its latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.scale import running_totals, without

#: Fixed values.
DEFAULT_TITLE, TITLE_CHARS = "New conversation", 32
ROLES, FEEDBACK = ("user", "assistant"), ("helpful", "not_helpful")
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def latest_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each id: the one with the latest ``updated_at``, then the greatest title."""
    row = F.struct("updated_at", "title", "created_at")
    return conversations.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(row).alias("r")).select("id", "r.title", "r.created_at", "r.updated_at")


def mapped_messages(messages: DataFrame) -> DataFrame:
    """Messages as the interface shows them: no sources become an empty list, times ISO text, never an error; feedback is not shown."""
    kind = messages.schema["sources"].dataType.simpleString()
    return messages.select(
        "id", "conversation_id", "role", "text",
        F.coalesce("sources", F.array().cast(kind)).alias("sources"),
        F.coalesce("is_empty", F.lit(False)).alias("is_empty"),
        F.lit(False).alias("is_error"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("created_at"),
    )


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row for each message id: of rows that differ, the least one in (time, the other columns), whatever the order of the rows."""
    others = [c for c in messages.columns if c not in ("id", "created_at")]
    row = F.struct(F.col("created_at").isNull().alias("_late"), "created_at", *others)
    one = messages.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(row).alias("r"))
    return one.select("id", "r.*").select(*messages.columns)


def message_places(messages: DataFrame) -> DataFrame:
    """Distinct messages of conversations with ``seq`` from 1 by time, then id, for conversations of any length."""
    rows = distinct_messages(messages).filter(F.col("conversation_id").isNotNull())
    placed = running_totals(rows, ["conversation_id"], [F.col("created_at").asc_nulls_first(), F.col("id").asc()], {"_before": F.lit(1)})
    return placed.withColumn("seq", F.col("_before") + 1).drop("_before")


def listed(conversations: DataFrame, messages: DataFrame, page_size: int = 200) -> DataFrame:
    """``(id, title, created_at, updated_at, page, messages)``: each conversation in pages of at most ``page_size`` nested messages.

    A conversation without messages has one page without any. No value holds more than a page, whatever a conversation's length.
    """
    placed = message_places(messages).withColumn("page", F.floor((F.col("seq") - 1) / page_size).cast("int") + 1)
    places = placed.select("id", "seq", "page")
    m = mapped_messages(placed).join(places, "id")
    nested = F.sort_array(F.collect_list(F.struct("seq", "id", "role", "text", "is_empty", "created_at")))
    by = m.groupBy("conversation_id", "page").agg(nested.alias("messages"))
    joined = latest_conversations(conversations).join(by, F.col("id") == F.col("conversation_id"), "left").drop("conversation_id")
    empty = F.array().cast(by.schema["messages"].dataType)
    return joined.withColumns({"messages": F.coalesce("messages", empty), "page": F.coalesce("page", F.lit(1))})


def newest_first(conversations: DataFrame) -> DataFrame:
    """In the order of the list: the latest ``updated_at`` first, those without one last, then by id."""
    return conversations.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id"))


def point_read(conversations: DataFrame, asked: DataFrame) -> DataFrame:
    """``(id, found, title, created_at, updated_at)`` for each asked id; an id of another form, or of no conversation, is not found."""
    known = latest_conversations(conversations).withColumn("_known", F.lit(True))
    rows = asked.select("id").distinct().withColumn("_valid", valid_id(F.col("id"))).join(known, "id", "left")
    found = F.col("_valid") & F.coalesce("_known", F.lit(False))
    return rows.select("id", found.alias("found"), *[F.when(found, F.col(c)).alias(c) for c in ("title", "created_at", "updated_at")])


def valid_id(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(UUID)), F.lit(False))


def created(ids: DataFrame, now: Column) -> DataFrame:
    return ids.select("id", F.lit(DEFAULT_TITLE).alias("title"), now.alias("created_at"), now.alias("updated_at"))


def renamed(conversations: DataFrame, renames: DataFrame) -> DataFrame:
    """Apply ``(id, title, at)``: the last of each id wins and its time becomes ``updated_at``."""
    last = renames.groupBy("id").agg(F.max(F.struct("at", "title")).alias("r")).select("id", F.col("r.title").alias("_t"), F.col("r.at").alias("_at"))
    out = conversations.join(last, "id", "left")
    return out.withColumns({"title": F.coalesce("_t", "title"), "updated_at": F.coalesce("_at", "updated_at")}).drop("_t", "_at")


def deleted(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given conversations and their messages."""
    gone = ids.select("id").distinct()
    return conversations.join(gone, "id", "left_anti"), without(messages, gone.withColumnRenamed("id", "conversation_id"), "conversation_id", "id")


def first_titles(messages: DataFrame) -> DataFrame:
    """``(conversation_id, title)``: the first 32 characters of the first user's message."""
    role = F.lower(F.trim("role"))
    users = messages.filter((role == "user") & F.col("text").isNotNull() & F.col("conversation_id").isNotNull())
    first = F.min(F.struct(F.col("created_at").isNull().alias("late"), "created_at", "id", "text")).alias("f")
    return users.groupBy("conversation_id").agg(first).select("conversation_id", F.left("f.text", F.lit(TITLE_CHARS)).alias("title"))


def turn_rows(turns: DataFrame) -> DataFrame:
    """The two rows of each turn ``(conversation_id, turn, question, answer, sources, at)``, in a defined order."""
    none = F.lit(None).cast(turns.schema["sources"].dataType)
    user = F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("text"), none.alias("sources"), F.lit(False).alias("is_empty"))
    empty = F.coalesce(F.size("sources") == 0, F.lit(True))
    reply = F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"), F.col("answer").alias("text"), F.col("sources"), empty.alias("is_empty"))
    return turns.select("conversation_id", "turn", F.col("at").alias("created_at"), F.explode(F.array(user, reply)).alias("m")).select(
        "conversation_id", (2 * F.col("turn") + F.col("m.seq")).alias("seq"), "m.role", "m.text", "m.sources", "m.is_empty", "created_at"
    )


def append_turns(conversations: DataFrame, messages: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations after the turns ``(conversation_id, turn, question, answer, sources, at)``, and the rows that the turns add.

    Turns of unknown conversations add nothing. A conversation without messages takes its title from its first question; every one takes the time
    of its last turn as ``updated_at``.
    """
    known = turns.join(conversations.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi")
    begun = messages.select("conversation_id").filter(F.col("conversation_id").isNotNull()).distinct().withColumn("_begun", F.lit(True))
    last = known.groupBy("conversation_id").agg(F.max("at").alias("_at"), F.min(F.struct("turn", "question")).alias("_first"))
    last = last.join(begun, "conversation_id", "left").withColumnRenamed("conversation_id", "id")
    title = F.when(F.col("_at").isNotNull() & F.col("_begun").isNull(), F.left("_first.question", F.lit(TITLE_CHARS))).otherwise(F.col("title"))
    after = conversations.join(last, "id", "left").withColumns({"title": F.coalesce(title, "title"), "updated_at": F.coalesce("_at", "updated_at")})
    return after.select(*conversations.columns), turn_rows(known)


FAILED = "Unable to send your message. Please try again."


def client_messages(events: DataFrame) -> DataFrame:
    """What a client shows after the events ``(conversation_id, seq, text, answer, sources, failed)``: a question at once, then its answer or an error.

    Blank questions are no events. ``place`` orders the rows of a conversation.
    """
    sent = events.filter(strip(F.col("text")) != "")
    none = F.lit(None).cast(events.schema["sources"].dataType)
    failed = F.coalesce("failed", F.lit(False))
    user = F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("text").alias("text"), none.alias("sources"), F.lit(False).alias("is_empty"), F.lit(False).alias("is_error"))
    reply = F.struct(
        F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.when(failed, F.lit(FAILED)).otherwise(F.col("answer")).alias("text"),
        F.when(~failed, F.col("sources")).alias("sources"), (~failed & F.coalesce(F.size("sources") == 0, F.lit(True))).alias("is_empty"), failed.alias("is_error"),
    )
    rows = sent.select("conversation_id", "seq", F.explode(F.array(user, reply)).alias("m"))
    return rows.select("conversation_id", (2 * F.col("seq") + F.col("m.k")).alias("place"), "m.role", "m.text", "m.sources", "m.is_empty", "m.is_error")


def client_titles(events: DataFrame) -> DataFrame:
    """``(conversation_id, title)``: the first question's start, if it was answered."""
    sent = events.filter(strip(F.col("text")) != "")
    first = sent.groupBy("conversation_id").agg(F.min(F.struct("seq", "text", "failed")).alias("f"))
    return first.filter(~F.coalesce("f.failed", F.lit(False))).select("conversation_id", F.left("f.text", F.lit(TITLE_CHARS)).alias("title"))


def active_after_delete(conversations: DataFrame, active: str | None, gone: str) -> str | None:
    """The open conversation after one is deleted: the same, or the first of the list that is left."""
    if active != gone:
        return active
    first = newest_first(conversations.filter(F.col("id") != gone)).select("id").first()
    return first["id"] if first else None


def with_boolean_flag(messages: DataFrame, column: str = "is_empty") -> DataFrame:
    """A table of an older version, whose flag is text, with the flag as a boolean; null and anything unknown is false."""
    return messages.withColumn(column, F.coalesce(F.lower(F.trim(F.col(column).cast("string"))).isin("true", "t", "1", "yes"), F.lit(False)))


def last_feedback(log: DataFrame, key: str = "message_id", value: str = "feedback", at: str = "at") -> DataFrame:
    """The last valid value of each key."""
    good = log.filter(F.col(value).isin(*FEEDBACK) & F.col(key).isNotNull())
    return good.groupBy(key).agg(F.max(F.struct(at, value)).alias("r")).select(key, F.col(f"r.{value}").alias(value))


def valid_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.lower(F.trim("role")).isin(*ROLES) & (strip(F.col("text")) != ""))


def route(question: Column) -> Column:
    """The topic whose words come first in the order of the rules: warranty, leave, order, none."""
    low = F.lower(question)
    return (
        F.when(F.contains(low, F.lit("warrant")), "warranty")
        .when(F.contains(low, F.lit("leave")), "leave")
        .when(F.contains(low, F.lit("order")) | F.contains(low, F.lit("status")), "order")
        .otherwise("none")
    )


def tone(is_error: Column, is_empty: Column) -> Column:
    return F.when(is_error, "error").when(is_empty, "empty").otherwise("normal")
