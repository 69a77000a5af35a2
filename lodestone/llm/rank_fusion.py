"""One ranking from several scores on unlike scales: Borda count.

Ranks within each source replace the scores, so neither range nor outliers nor the shape of a distribution matter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scale import cut_lineage, running_totals

#: Parts over which the chunks of one question are divided.
PARTS = 16


def valid_hits(hits: DataFrame) -> DataFrame:
    """``(qid, source, chunk_id, score)``: the latest row of each key, if its score is a finite number.

    Sources are compared by their letters and digits, whatever the case. Rows without question, source or chunk are no hits. Of rows
    with the same time the one with the highest finite score counts; a row without a time is older than any other.
    """
    score = F.col("score").cast("double")
    finite = F.when(~F.isnan(score) & (F.abs(score) < F.lit(float("inf"))), score)
    source = F.lower(F.regexp_replace(F.col("source"), r"[^\p{L}\p{N}]+", ""))
    rows = hits.select("qid", source.alias("source"), "chunk_id", finite.alias("score"), "retrieved_at")
    rows = rows.filter(F.col("qid").isNotNull() & F.col("chunk_id").isNotNull() & (F.col("source") != ""))
    latest = rows.groupBy("qid", "source", "chunk_id").agg(F.max(F.struct("retrieved_at", "score")).alias("last"))
    # -0.0 and 0.0 are one score
    kept = latest.select("qid", "source", "chunk_id", (F.col("last.score") + F.lit(0.0)).alias("score"))
    return kept.filter(F.col("score").isNotNull())


def average_ranks(hits: DataFrame) -> DataFrame:
    """``(qid, source, score, rank2, k)``: twice the rank of each score in its question and source, ties sharing the average of their places, and how
    many hits are ranked there.
    """
    counts = hits.groupBy("qid", "source", "score").agg(F.count(F.lit(1)).alias("ties"))
    placed = running_totals(counts, ["qid", "source"], [F.col("score").desc()], {"above": F.col("ties")}, whole=True)
    return placed.select("qid", "source", "score", (2 * F.col("above") + F.col("ties") + 1).alias("rank2"), F.col("above_all").alias("k"))


def borda_points(hits: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """``(qid, chunk_id, points)`` of every chunk hit for a question.

    With N chunks in a question, place r of a source gives N - r points. A chunk that a source does not score gets the
    mid-rank of the places that the source leaves open: of k scored chunks, (k + 1 + N) / 2. ``weights`` are whole
    numbers by source in lower case, 1 where missing. All sums are of whole numbers (points doubled), so the order in
    which rows arrive changes nothing. No hit gives no row; an empty input gives an empty result.

    What every source of a question gives to all its chunks is one number a question; it is joined by question and, for the chunks of a hot one,
    by one of 16 parts.
    """
    valid = cut_lineage(valid_hits(hits))
    weight = F.lit(1).cast("long")
    for source, w in (weights or {}).items():
        weight = F.when(F.col("source") == source.lower(), F.lit(int(w)).cast("long")).otherwise(weight)
    ranks = average_ranks(valid).withColumn("weight", weight)
    own = valid.join(ranks, ["qid", "source", "score"]).groupBy("qid", "chunk_id").agg(
        F.sum(F.col("weight") * (F.col("k") + 1 - F.col("rank2"))).alias("gain"), F.sum("weight").alias("hit_weight")
    )
    own = cut_lineage(own.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)).cast("int")))
    n = own.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    k = ranks.groupBy("qid", "source").agg(F.max("k").alias("k"), F.max("weight").alias("weight"))
    base = k.groupBy("qid").agg(F.sum(F.col("weight") * (F.col("k") + 1)).alias("wk"), F.sum("weight").alias("all_weight")).join(n, "qid")
    base = base.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # doubled points: sum over sources of w (2N - (k + 1 + N)), plus w ((k + 1 + N) - 2r) for each source that scores it
    doubled = F.col("all_weight") * F.col("n") - F.col("wk") + F.col("gain") + F.col("hit_weight") * F.col("n")
    return own.join(base, ["qid", "part"]).select("qid", "chunk_id", (doubled / F.lit(2.0)).alias("points"))


def borda_ranking(hits: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """:func:`borda_points` with ``position`` from 1; equal points go by chunk_id."""
    points = borda_points(hits, weights)
    order = [F.col("points").desc(), F.col("chunk_id").asc()]
    return running_totals(points, ["qid"], order, {"before": F.lit(1)}).select(
        "qid", "chunk_id", "points", (F.col("before") + 1).alias("position")
    )


def borda_winner(hits: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """``(qid, chunk_id)`` of the chunk that stands first, by partial aggregation."""
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("chunk_id").alias("c"))).alias("first")
    return borda_points(hits, weights).groupBy("qid").agg(first).select("qid", F.col("first.c").alias("chunk_id"))
