"""The queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import conversations, encoding, langid, leakage, markup, ocr_repair, pair_defects, rank_fusion, splitting
from lodestone.scale import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.borda_winner(table(spark, sf_dir, "retrieved_chunks"))


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.borda_ranking(table(spark, sf_dir, "retrieved_chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_repair.scan_repairs(table(spark, sf_dir, "phase1_chunks"))


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_repair.repair_scanned(table(spark, sf_dir, "phase1_chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_faults(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.rebuild_conversations(table(spark, sf_dir, "messages"), table(spark, sf_dir, "conversations"))
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_elements(table(spark, sf_dir, "phase1_chunks"))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.plain_blocks(table(spark, sf_dir, "phase1_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.defects(table(spark, sf_dir, "messages"), table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_boundaries(table(spark, sf_dir, "phase1_chunks"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "phase1_chunks"))


def p6_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.cover_of(table(spark, sf_dir, "phase1_chunks"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_texts(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the items that a document holds in another order, by four fifths of their words."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), coverage=0.8)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.relabelled(table(spark, sf_dir, "documents"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_segments(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_ranking": p1_ranking,
        "p2_found": p2_found,
        "p2_text": p2_text,
        "p3_found": p3_found,
        "p3_conversations": p3_conversations,
        "p4_found": p4_found,
        "p4_text": p4_text,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_pieces": p6_pieces,
        "p6_cover": p6_cover,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p8_passages": p8_passages,
        "p9_found": p9_found,
        "p9_segments": p9_segments,
    }
