"""The two long plans: building the corpus, and answering a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import fuse, index, retrieve, vector_index
from lodestone.operators.understand import understanding
from lodestone.scale import cut_lineage


#: An embedding model outside of the plan: ``(key, text)`` in, ``(key, embedding)`` out.
Embedder = Callable[[DataFrame], DataFrame]


def build_indexes(chunks: DataFrame, embedder: Embedder | None = None, kept: bool = False) -> dict[str, DataFrame]:
    """The parts of the lexical and exact indexes over distinct chunks, and of the vector index where an ``embedder`` is given.

    The lexical and the vector index are over the embedding text. Its terms are written once, a row a chunk (``bags``), since every part of the lexical index is made of them.
    With ``kept``, the distinct chunks are written first, for one who reads them again with the indexes.
    The vector index is an inverted file: ``vectors`` by cell, and ``centres`` with the number of cells to probe.
    """
    one = index.distinct_chunks(chunks)
    one = cut_lineage(one) if kept else one
    texts = one.select("chunk_id", index.embedding_text().alias("text"))
    held = cut_lineage(index.bags(texts))
    lengths, counts = held.select("chunk_id", "dl"), cut_lineage(index.term_counts(held.select(F.explode("terms").alias("term"))))
    parts = {
        "chunks": one, "bags": held, "postings": index.postings_of(held), "doc_len": lengths, "terms": index.term_stats(counts, lengths), "exact_index": index.exact_index(one),
    }
    if embedder is not None:
        vectors = cut_lineage(index.unit_vectors(embedder(texts), "chunk_id", "embedding"))
        centres = vector_index.fit(vectors, key="chunk_id")
        parts["vectors"] = vector_index.build(vectors, centres, key="chunk_id")
        parts["centres"] = vector_index.to_table(chunks.sparkSession, centres)
    return parts


def search_vectors(asked: DataFrame, parts: dict[str, DataFrame], top: int = retrieve.VECTOR_TOP) -> DataFrame:
    """The ranked lists ``(qid, chunk_id, score, rank)`` of embedded questions ``(qid, unit)`` by the vector part of an index."""
    return vector_index.search(asked, parts["vectors"], vector_index.from_table(parts["centres"]), top=top, key="chunk_id")


def question_keys(questions: DataFrame, text: str = "text") -> DataFrame:
    """``(qid, kind, key)`` of the codes and models that a question names."""
    from lodestone.operators.extract import ERROR_CODE, MODEL_CODE

    upper = F.upper(F.col(text))
    parts = [
        questions.select("qid", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(upper, F.lit(p), F.lit(0))).alias("key"))
        for kind, p in (("error_codes", ERROR_CODE), ("model_names", MODEL_CODE))
    ]
    return parts[0].unionByName(parts[1])


#: What a question's table may already tell of it, as fields of a model's reply.
TOLD = ("translated_query", "language", "is_roman_urdu", "intent", "product_category", "confidence")


def understood(questions: DataFrame) -> DataFrame:
    """``(qid, text)`` with the understanding's fields, out of what the table tells of a question and the codes and models it names."""
    named = question_keys(questions).groupBy("qid").pivot("kind", ["error_codes", "model_names"]).agg(F.array_sort(F.collect_set("key")))
    reply = F.to_json(F.struct(*[c for c in TOLD if c in questions.columns], "error_codes", "model_names"))
    one = questions.join(named, "qid", "left")
    return one.select("qid", "text", understanding(F.col("text"), reply).alias("u")).select("qid", "text", "u.*").drop("original_query")


def hits_of(questions: DataFrame, parts: dict[str, DataFrame], vector_hits: DataFrame | None = None, top: int = fuse.FUSED_TOP) -> DataFrame:
    """``(qid, source, rank, chunk_id, score)`` of the exact, vector and lexical ways as one table of ranked lists, for understood questions.

    Of the exact way, whose hits have no limit, those that the other ways have too, and the first ``top``: any later one is behind these when they are fused.
    """
    kinds = ("error_codes", "model_names")
    keys = [questions.select("qid", F.lit(kind).alias("kind"), F.explode(kind).alias("key")) for kind in kinds]
    lexical = retrieve.lexical_topk(questions, parts.get("bags", parts["postings"]), parts["doc_len"], parts["terms"], text="translated_query")
    lists = lexical.withColumn("source", F.lit("bm25"))
    if vector_hits is not None:
        lists = lists.unionByName(vector_hits.select("qid", "chunk_id", "score", "rank").withColumn("source", F.lit("vector")))
    lists = cut_lineage(lists)
    exact = retrieve.exact_ranks(keys[0].unionByName(keys[1]), parts["exact_index"], lists, top)
    return lists.unionByName(exact.withColumn("source", F.lit("exact")))


def answer_batch(questions: DataFrame, parts: dict[str, DataFrame], vector_hits: DataFrame | None = None, scorer=fuse.overlap_score) -> DataFrame:  # noqa: ANN001
    """``(qid, language, context, prompt)`` and the other fields of the understanding for many questions in one lazy plan.

    Understand, retrieve, fuse, rerank, assemble. ``vector_hits`` are the ranked lists ``(qid, chunk_id, score, rank)`` of the vector search, whose
    embedding model is outside of the plan; without them two ways are fused.
    """
    told = cut_lineage(understood(questions))  # every way of the search begins with it
    fused = fuse.rrf(hits_of(told, parts, vector_hits)).drop("score")
    found = fused.join(told.select("qid", F.col("translated_query").alias("question")), "qid").join(parts["chunks"], "chunk_id")
    final = fuse.rerank(found, scorer).select("qid", "chunk_id", "rank").join(parts["chunks"], "chunk_id")  # so that only the final texts are moved to their question
    shown = F.coalesce("context", F.lit(""))
    asked = fuse.prompt(F.col("text"), F.col("translated_query"), F.col("language"), shown)
    out = told.join(fuse.context(final), "qid", "left")
    return out.select(
        "qid", "language", shown.alias("context"), asked.alias("prompt"), "translated_query", "is_roman_urdu", "error_codes", "model_names", "intent", "product_category", "confidence"
    )
