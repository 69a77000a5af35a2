"""Readers and writers of the formats that the engine takes in and gives out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import newlines
from lodestone.scale import cut_lineage, running_totals
from lodestone.schemas import CHUNKS, LAYOUT_ITEMS


def read_manuals(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, raw)``: each Markdown file as one row, named by its file. A missing path raises."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(F.url_decode(name).alias("doc_id"), newlines(F.col("value")).alias("raw"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def read_layout_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT_ITEMS).json(path)


def read_pdf_names(spark: SparkSession, folder: str) -> DataFrame:
    """The PDF files of a folder in the order of their paths; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "length").orderBy("path")


def first_pdf(spark: SparkSession, folder: str) -> DataFrame:
    """The one that comes first by path; none of an empty folder."""
    return read_pdf_names(spark, folder).limit(1)


def read_rules(spark: SparkSession, path: str, most: int = 10_000) -> tuple[tuple[str, str], ...]:
    """``(pattern, replacement)`` rules of a product line, in their order, from JSON lines ``{"place", "pattern", "replacement"}``.

    They become parts of an expression, so more than ``most`` are an error.
    """
    rows = spark.read.schema("place int, pattern string, replacement string").json(path).orderBy("place").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules under {path}")
    return tuple((r["pattern"], r["replacement"]) for r in rows)


def read_categories(spark: SparkSession, path: str, most: int = 10_000) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Product categories in their order with their needles, from JSON lines ``{"place", "category", "needle"}``; as bounded as :func:`read_rules`."""
    rows = spark.read.schema("place int, category string, needle string").json(path).orderBy("place", "needle").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} needles under {path}")
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["category"], []).append(r["needle"].lower())
    return tuple((c, tuple(n)) for c, n in by.items())


def read_index(spark: SparkSession, path: str, part: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/{part}")
    except Exception as e:
        raise FileNotFoundError(f"no {part} under {path}: build the index first") from e


def write_index(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as a table of its own, replacing what was there; vectors by cell, so that a search reads the probed cells only."""
    for name, df in parts.items():
        # a cell of any size is divided over a few tasks and files
        out = df.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("cell") if name == "vectors" else df.write
        out.mode("overwrite").parquet(f"{path}/{name}")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a line."""
    chunks.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_arrays(rows: DataFrame, path: str, order: list[str], part_size: int = 10_000) -> None:
    """JSON arrays of at most ``part_size`` objects, one a line, in the order of the columns ``order``; characters beyond ASCII stay."""
    placed = running_totals(rows.withColumn("_all", F.lit(1)), ["_all"], [F.col(c).asc() for c in order], {"_before": F.lit(1)})
    parts = placed.withColumn("_part", F.floor(F.col("_before") / part_size))
    value = F.struct("_before", F.struct(*rows.columns).alias("row"))
    arrays = parts.groupBy("_part").agg(F.transform(F.sort_array(F.collect_list(value)), lambda x: x["row"]).alias("rows"))
    arrays.orderBy("_part").select(F.to_json("rows").alias("value")).write.mode("overwrite").text(path)


#: Parts over which documents are divided by their id; a part is a folder, whatever the number of documents.
BUCKETS = 256


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


def write_documents(rendered: DataFrame, path: str) -> None:
    """``(doc_id, ...)`` rows, such as rendered Markdown and flat text, by bucket of their id."""
    by = rendered.withColumn("bucket", bucket(F.col("doc_id")))
    by.repartition("bucket", F.xxhash64("doc_id") % 7).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_documents(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """All written documents, or one, of which only the bucket is read."""
    rows = spark.read.parquet(path)
    if doc_id is not None:
        rows = rows.filter((F.col("bucket") == bucket(F.lit(doc_id))) & (F.col("doc_id") == doc_id))
    return rows.drop("bucket")


def merge_documents(rows: DataFrame, path: str) -> None:
    """Replace what is held of the documents in ``rows`` (``doc_id`` and other columns) by them; other documents stay. Only their buckets are read and written.

    Run again with the same rows it writes the same.
    """
    spark = rows.sparkSession
    new = cut_lineage(rows.withColumn("bucket", bucket(F.col("doc_id"))))
    mine = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # of BUCKETS at most
    try:
        held = spark.read.parquet(path).filter(F.col("bucket").isin(mine))
        kept = held.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(*new.columns)
        new = cut_lineage(new.unionByName(kept))
    except AnalysisException:
        pass  # nothing is held yet
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_cache(new: DataFrame, path: str) -> None:
    """Write through what a cache lacked."""
    new.write.mode("append").parquet(path)


def exact_map(index: DataFrame, part_size: int = 10_000) -> DataFrame:
    """The exact index as ``(kind, key, part, chunk_ids)`` for export: ids in order, at most ``part_size`` in a value."""
    placed = running_totals(index, ["kind", "key"], [F.col("chunk_id").asc()], {"_before": F.lit(1)})
    parts = placed.withColumn("part", F.floor(F.col("_before") / part_size).cast("int") + 1)
    return parts.groupBy("kind", "key", "part").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def write_exact_map(index: DataFrame, path: str) -> None:
    exact_map(index).write.mode("overwrite").json(path)


def read_exact_map(spark: SparkSession, path: str) -> DataFrame:
    """The exported exact index as ``(kind, key, chunk_id)`` again."""
    rows = spark.read.schema("kind string, key string, part int, chunk_ids array<string>").json(path)
    return rows.select("kind", "key", F.explode("chunk_ids").alias("chunk_id"))


def healthy(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 1 AS ok")
