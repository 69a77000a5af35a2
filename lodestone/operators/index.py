"""Inverted, lexical and vector indexes as ordinary tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import blank_to_null, strip, tokenize

#: The usual constants of the lexical score (fixed values).
K1, B, EPSILON = 1.5, 0.75, 0.25


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each chunk id; of rows that differ, the least text."""
    row = F.struct("text", *[c for c in ("metadata", "manual_id") if c in chunks.columns])
    one = chunks.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min_by(row, F.col("text")).alias("r"))
    return one.select("chunk_id", "r.*")


def _label(c: Column) -> Column:
    return F.when((c != "") & (c != "general"), F.replace(c, F.lit("_"), F.lit(" ")))


def embedding_text(meta: str = "metadata", text: str = "text") -> Column:
    """Section, product, error codes and the first ten models as lines before the text; empty ones are left out."""
    m = F.col(meta)
    codes, models = F.array_join(m["error_codes"], ", "), F.array_join(F.slice(m["model_names"], 1, 10), ", ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Section: "), blank_to_null(m["title"])),
        F.concat(F.lit("Product: "), _label(m["product_category"])),
        F.concat(F.lit("Error Codes: "), blank_to_null(codes)),
        F.concat(F.lit("Models: "), blank_to_null(models)),
        F.coalesce(F.col(text), F.lit("")),
    )


def rerank_text(meta: str = "metadata", text: str = "text") -> Column:
    m = F.col(meta)
    return F.concat_ws("\n", blank_to_null(m["title"]), _label(m["product_category"]), blank_to_null(F.col(text)))


_TOKEN = re.compile("[a-z0-9]+")


def bags(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(key, dl, terms, tfs)`` of texts whose keys do not repeat: how many terms a text has, its distinct ones and the uses of each.

    One row holds a text's postings, so none is moved to be counted. The terms are those of :func:`tokenize`, which signs only part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            sizes, terms, tfs, ends = [], [], [], [0]
            for value in batch.column(1).to_pylist():
                found = _TOKEN.findall(value.lower()) if value is not None else []
                held = Counter(found)
                sizes.append(None if value is None else len(found))
                terms.extend(held)
                tfs.extend(held.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((terms, pa.string()), (tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=[key, "dl", "terms", "tfs"])

    return texts.select(key, text).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, dl bigint, terms array<string>, tfs array<int>")


def postings_of(held: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(term, key, tf)`` of :func:`bags`."""
    return held.select(key, F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), key, F.col("p.tfs").cast("long").alias("tf"))


def tokenized(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(key, terms)``, from which all parts of a lexical index can be made."""
    return texts.select(key, tokenize(F.col(text)).alias("terms"))


def _terms(texts: DataFrame, text: str) -> Column:
    return F.col("terms") if "terms" in texts.columns else tokenize(F.col(text))


def postings(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(term, key, tf)`` of texts, or of :func:`tokenized` ones."""
    terms = texts.select(key, F.explode(_terms(texts, text)).alias("term"))
    return terms.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    return texts.select(key, F.size(_terms(texts, text)).cast("long").alias("dl"))


def term_counts(post: DataFrame) -> DataFrame:
    """``(term, df)``: in how many texts a term stands."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_stats(post: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(term, df, idf)`` of postings or of :func:`term_counts`: idf is ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes a share of the mean over all terms.

    The totals are one row each and joined as such; no document is gathered.
    """
    n = lengths.agg(F.count(F.lit(1)).alias("n"))
    raw = (post if "df" in post.columns else term_counts(post)).join(F.broadcast(n))
    raw = raw.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf"))
    mean = raw.agg(F.avg("raw_idf").alias("mean_idf"))
    idf = F.when(F.col("raw_idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw_idf"))
    return raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


def exact_index(chunks: DataFrame) -> DataFrame:
    """``(kind, key, chunk_id)`` of error codes and model names in upper case, stripped, not empty."""
    m = F.col("metadata")
    parts = [
        chunks.select(F.lit(kind).alias("kind"), F.explode(m[kind]).alias("key"), "chunk_id") for kind in ("error_codes", "model_names")
    ]
    rows = parts[0].unionByName(parts[1]).withColumn("key", F.upper(strip(F.col("key"))))
    return rows.filter(F.col("key") != "").distinct()


def index_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("kind").agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("entries"))


def unit_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, unit)`` with length one; null and zero vectors are left out."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(F.col("_v"), F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(*[c for c in vectors.columns if c != vector], v.alias("_v")).withColumn("_n", norm)
    return rows.filter(F.col("_n") > 0).withColumn("unit", F.transform("_v", lambda x: x / F.col("_n"))).drop("_v", "_n")
