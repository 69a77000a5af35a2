"""Incremental ingest: new manual files become chunks as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import newlines
from lodestone.operators.parse import parse_manuals
from lodestone.scale import query_tables
from lodestone.sources.tables import merge_documents


def stream_manuals(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.option("wholetext", True).format("text").schema("value string").load(folder)
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1))
    return files.select(name.alias("doc_id"), newlines(F.col("value")).alias("raw"))


def ingest(manuals: DataFrame, target: str, state: str, once: bool = True, parse: Callable[[DataFrame], DataFrame] = parse_manuals) -> StreamingQuery:
    """Parse each micro-batch and replace the chunks of its documents under ``target``, which is divided by buckets of their ids.

    A batch that is run again writes the same buckets with the same rows, so a restart repeats nothing. Chunks never depend on another
    document, hence no state and no watermark.
    """

    def write(batch: DataFrame, _: int) -> None:
        with query_tables():
            merge_documents(parse(batch), target)

    writer = manuals.writeStream.foreachBatch(write).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()
