"""Fusion of ranked lists, reranking, and the context for an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokenize
from lodestone.operators.index import rerank_text
from lodestone.scale import running_totals

#: Fixed values.
RRF_K, FUSED_TOP, FINAL_TOP, CONTEXT_CHARS = 60, 10, 5, 1500
SOURCES = ("exact", "vector", "bm25")


def ranked_lists(hits: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """``(qid, source, rank, chunk_id)`` out of stored hits: the best score of a chunk in a source, ranked by score, then by id."""
    score = F.col("score")
    source = F.lower(F.trim("source"))
    rows = hits.select("qid", source.alias("source"), "chunk_id", "score").filter(F.col("source").isin(*sources) & score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")))
    best = rows.groupBy("qid", "source", "chunk_id").agg(F.max("score").alias("score"))
    placed = running_totals(best, ["qid", "source"], [F.col("score").desc(), F.col("chunk_id").asc()], {"_before": F.lit(1)})
    return placed.withColumn("rank", (F.col("_before") + 1).cast("int")).drop("_before")


def rrf(lists: DataFrame, k: int = RRF_K, top: int | None = FUSED_TOP, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """``(qid, chunk_id, score, fused_rank)``: the sum of 1 / (k + rank), added in the order of the sources.

    Equal scores go to the chunk that an earlier source holds, then to its rank there.
    """
    shares = [F.coalesce(F.sum(F.when(F.col("source") == s, 1.0 / (k + F.col("rank")))), F.lit(0.0)) for s in sources]
    total = shares[0]
    for share in shares[1:]:
        total = total + share
    place = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(sources) for x in (s, i)]), F.col("source"))
    fused = lists.filter(F.col("source").isin(*sources)).groupBy("qid", "chunk_id").agg(total.alias("score"), F.min(F.struct(place, F.col("rank"))).alias("first"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("first").asc(), F.col("chunk_id").asc())
    out = fused.withColumn("fused_rank", F.row_number().over(w)).drop("first")
    return out if top is None else out.filter(F.col("fused_rank") <= top)


def overlap_score(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a scoring model: the share of the question's distinct terms that the text holds."""
    q = F.array_distinct(tokenize(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.array_distinct(tokenize(text)))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] | None = overlap_score, top: int = FINAL_TOP) -> DataFrame:
    """The best ``top`` of each question's fused candidates ``(qid, question, fused_rank, chunk_id, text, metadata)``.

    Only fused candidates reach the scorer. Equal scores keep the fused order. Without a scorer the first ones stay, with score 0
    and source ``rrf``.
    """
    if scorer is None:
        kept = candidates.filter(F.col("fused_rank") <= top)
        return kept.withColumns({"score": F.lit(0.0), "source": F.lit("rrf"), "rank": F.col("fused_rank")})
    scored = candidates.withColumns({"score": scorer(F.col("question"), rerank_text()), "source": F.lit("rerank")})
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("fused_rank").asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def context(final: DataFrame) -> DataFrame:
    """``(qid, context)``: the final chunks of a question, each under a line that names it, cut at 1500 characters."""
    m = F.col("metadata")
    head = F.concat(
        F.lit("--- CHUNK ["), F.col("chunk_id"), F.lit("] (Page "), F.coalesce(m["page_start"].cast("string"), F.lit("None")), F.lit(", Section: "),
        F.coalesce(m["title"], F.lit("None")), F.lit(") ---\n"), F.left("text", F.lit(CONTEXT_CHARS)),
    )
    parts = F.sort_array(F.collect_list(F.struct("rank", head.alias("part"))))
    return final.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("context"))


def prompt(question: Column, translated: Column, language: Column, text: Column) -> Column:
    """The text for an answering model; the model itself is called outside of any plan."""
    return F.concat(
        F.lit("Question ("), language, F.lit("):\n"), question, F.lit("\n\nIn English:\n"), translated, F.lit("\n\nContext:\n"), text,
        F.lit("\n\nAnswer from the context only, in "), language, F.lit(", naming the chunks used. If the context does not say, say so.\n"),
    )


def retrieval_stats(lists: DataFrame, fused: DataFrame, final: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """How many rows each step had for each question."""
    counts = lists.groupBy("qid").agg(*[F.count_if(F.col("source") == s).alias(f"{s}_hits") for s in sources])
    f = fused.groupBy("qid").agg(F.count(F.lit(1)).alias("fused"))
    r = final.groupBy("qid").agg(F.count(F.lit(1)).alias("final"))
    return counts.join(f, "qid", "left").join(r, "qid", "left").na.fill(0, ["fused", "final"])
