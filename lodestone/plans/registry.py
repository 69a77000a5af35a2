"""The queries of the engine's operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chat, extract, fuse, index, layout, parse, retrieve, understand, vector_index
from lodestone.plans import pipeline
from lodestone.scale import table
from lodestone.schemas import SOURCES
from lodestone.sources.tables import exact_map

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- inputs ----------------------------------------------------------------------------------------------------------------------


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return index.distinct_chunks(table(spark, d, "phase1_chunks"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions")


def series(spark: SparkSession, d: str) -> list[str]:
    """All series names of the product table."""
    rows = table(spark, d, "product_models").select("series").distinct().orderBy("series").collect()
    return [r["series"] for r in rows if r["series"]]


def manuals(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk written out as a small manual of up to three pages, with divider, continuation marks and headings."""
    m = F.col("metadata")
    first = F.coalesce(m["page_start"], F.lit(1))
    n = first.cast("string")
    title = F.coalesce(m["title"], F.lit("Untitled"))
    lines = F.array(
        F.concat(F.lit("## PAGE "), n), F.concat(F.lit("# "), title),
        F.concat(F.lit("PAGE\n"), (first + 1).cast("string")), F.concat(F.lit("# "), title, F.lit(" (Cont..)")), T.newlines(F.col("text")),
        F.concat(F.lit("PAGE "), (first + 2).cast("string")), F.concat(F.lit("## "), F.coalesce(m["section"], F.lit("features"))), F.lit("Cont......"),
        T.newlines(F.col("text")), F.concat(F.lit("## "), F.coalesce(m["section"], F.lit("features"))), F.lit("See the table of error codes and check whether the supply is on: yes or no."),
    )
    return chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), F.array_join(lines, "\n").alias("raw"))


def layout_items(spark: SparkSession, d: str) -> DataFrame:
    """Boxes, labels and texts laid out of the order lines, an order being a document."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    li = table(spark, d, "lineitem").withColumn("n", F.row_number().over(order))
    q, p = F.col("l_quantity").cast("double"), F.col("l_partkey")
    left, top = (p % 7 * 80).cast("double"), (780 - p % 40 * 18).cast("double")
    box = F.struct(left.alias("l"), top.alias("t"), (left + 60 + q / 3).alias("r"), (top - 12 - q / 7).alias("b"))
    labels = F.array(*[F.lit(x) for x in ("text", "section_header", "list_item", "table", "picture", "title", "text")])
    label = F.element_at(labels, (p % 7 + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.col("n").alias("item_ord"), (F.col("l_suppkey") % 4).cast("int").alias("level"),
        F.lit("text").alias("type"), label.alias("label"), F.ceil(F.col("n") / 9).cast("int").alias("page"),
        F.concat(F.lit("part "), p.cast("string"), F.lit(" by "), F.coalesce("l_returnflag", F.lit(""))).alias("content"),
        F.when(p % 11 != 0, box).alias("bbox"),
    )


def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    """Recognised lines with scores: the lines of the chunks, scored by their length."""
    rows = chunks(spark, d).select("chunk_id", F.posexplode(F.split(T.newlines(F.col("text")), "\n")).alias("line_ord", "text"))
    return rows.select(F.col("chunk_id").alias("image_id"), "line_ord", "text", (F.length("text") % 10 / 10.0).alias("score"))


def rounded(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


# --- lexical index ---------------------------------------------------------------------------------------------------------------


@query
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    post = index.postings(chunks(spark, d))
    return post.groupBy("term").agg(F.sum("tf").alias("uses"), F.count(F.lit(1)).alias("chunks"))


@query
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    parts = pipeline.build_indexes(table(spark, d, "phase1_chunks"))
    return parts["terms"].select("term", "df", rounded("idf").alias("idf"))


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    p = pipeline.build_indexes(table(spark, d, "phase1_chunks"))
    return retrieve.lexical_topk(questions(spark, d), p["bags"], p["doc_len"], p["terms"]).select("qid", "chunk_id", rounded("score").alias("score"), "rank")


@query
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", index.embedding_text().alias("embedding_text"))


@query
def rerank_text(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", index.rerank_text().alias("rerank_text"))


# --- exact index -----------------------------------------------------------------------------------------------------------------


@query
def exact_index_build(spark: SparkSession, d: str) -> DataFrame:
    return index.exact_index(chunks(spark, d))


@query
def exact_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.index_stats(index.exact_index(chunks(spark, d)))


@query
def exact_index_export(spark: SparkSession, d: str) -> DataFrame:
    return exact_map(index.exact_index(chunks(spark, d))).select("kind", "key", "part", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that the exact retriever named; ids without a chunk are skipped."""
    hits = table(spark, d, "retrieved_chunks").filter(F.lower(F.trim("source")) == "exact").select("chunk_id").distinct()
    return retrieve.lookup(hits, chunks(spark, d)).select("chunk_id", F.length("text").alias("chars"), F.col("metadata.section").alias("section"))


@query
def exact_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieve.exact_hits(pipeline.question_keys(questions(spark, d)), index.exact_index(chunks(spark, d)))
    return retrieve.ranked(hits)


@query
def exact_match_normalized(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieve.exact_hits(pipeline.question_keys(questions(spark, d)), index.exact_index(chunks(spark, d)), mode="normalized")
    return retrieve.ranked(hits)


# --- vectors ---------------------------------------------------------------------------------------------------------------------


def _vector_search(spark: SparkSession, d: str, category: bool) -> DataFrame:
    """Queries are all vectors whose id is divisible by 50, against all vectors."""
    vectors = index.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("label", F.col("label").cast("string"))
    asked = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "unit", "label")
    found = retrieve.nearest(asked, vectors, category="label" if category else None)
    return found.select("qid", "vec_id", rounded("score").alias("score"), "rank")


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vector_search(spark, d, False)


@query
def vector_topk_category_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _vector_search(spark, d, True)


@query
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same queries by the inverted file, with as many cells and probes as were fitted."""
    vectors = index.unit_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    centres = vector_index.fit(vectors)
    asked = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "unit")
    found = vector_index.search(asked, vector_index.build(vectors, centres), centres)
    return found.select("qid", "vec_id", rounded("score").alias("score"), "rank")


@query
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the inverted file finds at least nine tenths of the exact neighbours."""
    exact, found = vector_topk(spark, d).select("qid", "vec_id"), vector_index_topk(spark, d).select("qid", "vec_id", F.lit(1).alias("hit"))
    share = F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))
    return exact.join(found, ["qid", "vec_id"], "left").agg(F.count(F.lit(1)).alias("neighbours"), (share >= 0.9).alias("enough"))


# --- fusion ----------------------------------------------------------------------------------------------------------------------


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return fuse.ranked_lists(table(spark, d, "retrieved_chunks"))


def _final(spark: SparkSession, d: str) -> DataFrame:
    fused = fuse.rrf(_lists(spark, d)).drop("score")
    found = fused.join(chunks(spark, d), "chunk_id").join(questions(spark, d).select("qid", F.col("text").alias("question")), "qid")
    return fuse.rerank(found)


@query
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fuse.rrf(_lists(spark, d)).select("qid", "chunk_id", rounded("score", 9).alias("score"), "fused_rank")


@query
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d).select("qid", "chunk_id", rounded("score").alias("score"), "source", "rank")


@query
def rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    fused = fuse.rrf(_lists(spark, d)).drop("score").join(chunks(spark, d).select("chunk_id", "text", "metadata"), "chunk_id")
    return fuse.rerank(fused, scorer=None).select("qid", "chunk_id", "score", "source", "rank")


@query
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    return fuse.context(_final(spark, d))


@query
def retrieval_stats(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    return fuse.retrieval_stats(lists, fuse.rrf(lists), _final(spark, d))


@query
def answer_batch(spark: SparkSession, d: str) -> DataFrame:
    parts = pipeline.build_indexes(table(spark, d, "phase1_chunks"), kept=True)
    answers = pipeline.answer_batch(questions(spark, d), parts, fuse.ranked_lists(table(spark, d, "retrieved_chunks"), sources=("vector",)))
    told = ("is_roman_urdu", *[F.array_join(c, ",").alias(c) for c in ("error_codes", "model_names")], "intent", "product_category", "confidence")
    return answers.select("qid", "language", F.length("context").alias("context_chars"), F.length("prompt").alias("prompt_chars"), *told)


# --- parsing ---------------------------------------------------------------------------------------------------------------------


@query
def parse_pages(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_pages(manuals(spark, d))


@query
def divider_pages(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_pages(manuals(spark, d)).select("doc_id", "page_ord", parse.is_divider(F.col("text")).alias("divider"))


@query
def clean_continuations(spark: SparkSession, d: str) -> DataFrame:
    return parse.clean_continuations(parse.parse_pages(manuals(spark, d))).select("doc_id", "page_ord", "text", "has_cont")


def _raw_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = parse.parse_pages(manuals(spark, d))
    return parse.heading_sections(parse.clean_continuations(pages.filter(~parse.is_divider(F.col("text")))))


def _flat(sections: DataFrame) -> DataFrame:
    return sections.select(
        "doc_id", "section", F.array_join("heading_path", " > ").alias("path"), "content", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages")
    )


@query
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_raw_sections(spark, d))


@query
def merge_sections(spark: SparkSession, d: str) -> DataFrame:
    return _flat(parse.merge_sections(_raw_sections(spark, d)))


@query
def paragraph_packing(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select("chunk_id", F.posexplode(parse.pack_paragraphs(T.newlines(F.col("text")))).alias("part", "body"))
    return rows.select("chunk_id", "part", F.length("body").alias("chars"), F.md5("body").alias("digest"))


@query
def chunk_routing(spark: SparkSession, d: str) -> DataFrame:
    routed = parse.route_sections(parse.sections_of(manuals(spark, d)))
    return routed.select("doc_id", "section", "content_type", F.size("parts").alias("parts"))


@query
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    rows = parse.parse_manuals(manuals(spark, d), series(spark, d), prefix="c_")
    return rows.select(
        "chunk_id", F.length("text").alias("chars"), m["title"].alias("title"), m["page_start"].alias("page_start"), m["page_end"].alias("page_end"),
        m["product_category"].alias("category"), m["section"].alias("section"), m["content_type"].alias("content_type"),
    )


@query
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    r = parse.ingest_report(manuals(spark, d))
    return r.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("divider_pages_removed", "continuation_marker_pages")})


@query
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = parse.parse_manuals(manuals(spark, d))
    return rows.groupBy(F.col("metadata.content_type").alias("content_type"), F.col("metadata.product_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


# --- metadata --------------------------------------------------------------------------------------------------------------------


@query
def model_names(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", F.array_join(extract.model_names(F.col("text"), series(spark, d)), ",").alias("models"))


@query
def error_codes(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", F.array_join(extract.error_codes(T.newlines(F.col("text"))), ",").alias("codes"))


@query
def markdown_table_cells(spark: SparkSession, d: str) -> DataFrame:
    return extract.table_cells(chunks(spark, d).withColumn("text", T.newlines(F.col("text"))))


@query
def table_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select("chunk_id", F.explode(extract.table_codes(T.newlines(F.col("text")))).alias("code"))
    return rows.distinct()


@query
def content_type(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", parse.content_type(F.col("text")).alias("content_type"))


@query
def flowchart_flag(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", parse.is_flowchart(F.col("text")).alias("flowchart"))


def _title() -> Column:
    return F.coalesce(F.col("metadata.title"), F.lit(""))


@query
def product_category(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", extract.product_category(F.col("text"), _title()).alias("category"))


@query
def section_label(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", extract.section_label(F.col("text"), parse.content_type(F.col("text")), _title()).alias("section"))


# --- layout ----------------------------------------------------------------------------------------------------------------------


@query
def ocr_clean(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", layout.clean_ocr(F.col("text")).alias("text"))


@query
def ocr_garbage_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = ocr_lines(spark, d).select("image_id", "line_ord", layout.is_garbage(F.col("text")).alias("garbage"))
    return rows.groupBy("image_id").agg(F.count_if("garbage").alias("garbage"), F.count(F.lit(1)).alias("lines"))


@query
def ocr_line_agg(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.recognised_text(ocr_lines(spark, d))
    return rows.select("image_id", F.md5("text").alias("digest"), rounded("confidence").alias("confidence"), "dropped")


@query
def picture_gate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    w, h = F.col("p_size") * 10, F.col("p_size") * 7
    size = layout.upscaled(w, h)
    nested, seen = F.repeat("p_name", F.col("p_size")), F.col("p_type")
    best = layout.best_text(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")), F.when(F.col("p_partkey") % 2 == 0, seen), F.col("p_retailprice").cast("double") / 10000)
    return p.select(
        "p_partkey", size["width"].alias("width"), size["height"].alias("height"), layout.needs_description(w, h, nested, seen).alias("describe"),
        layout.likely_table(F.col("p_name")).alias("likely_table"), best["text"].alias("text"), best["source"].alias("source"), best["confidence"].alias("confidence"),
        layout.picture_content(F.col("p_brand"), F.lit(None).cast("string"), F.when(F.col("p_partkey") % 2 == 0, seen)).alias("content"),
    )


@query
def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    lo = F.col("l_quantity").cast("double")
    spans = li.select("l_orderkey", lo.alias("lo"), (lo + F.col("l_linenumber") * 2).alias("hi"))
    return layout.gaps(spans, ["l_orderkey"])


@query
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(layout_items(spark, d)).select("doc_id", "page", "item_ord", "reading_order")


@query
def page_context(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_context(layout_items(spark, d))


@query
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return layout.rendered_documents(layout.normalise_items(layout_items(spark, d)), order="item_ord")


@query
def flat_text(spark: SparkSession, d: str) -> DataFrame:
    docs = layout.rendered_documents(layout.normalise_items(layout_items(spark, d)), order="item_ord")
    return docs.select("doc_id", F.md5("flat").alias("digest"), F.length("flat").alias("chars"))


@query
def markdown_with_preamble(spark: SparkSession, d: str) -> DataFrame:
    items = layout.normalise_items(layout_items(spark, d))
    docs = layout.rendered_documents(items, order="item_ord").join(layout.item_summary(items), "doc_id")
    docs = layout.with_preamble(docs, [("Source", "doc_id"), ("Pages", "total_pages")])
    return docs.select("doc_id", F.md5("markdown").alias("digest"))


@query
def structured_items(spark: SparkSession, d: str) -> DataFrame:
    """The header line of each document, and how many lines follow it."""
    lines = layout.structured_lines(layout.normalise_items(layout_items(spark, d)), order="item_ord")
    head = F.max(F.when(F.col("line_no") == 0, F.col("value"))).alias("header")
    return lines.groupBy("doc_id").agg(head, F.count_if(F.col("line_no") > 0).alias("items"))


@query
def item_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.item_summary(layout_items(spark, d))
    return rows.select("doc_id", "total_pages", "total_items", F.to_json("item_breakdown").alias("item_breakdown"))


@query
def table_items(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as tables of three cells; every fifth has an error in place of them."""
    items = layout_items(spark, d).filter(F.col("label") == "table")
    cell = F.col("item_ord").cast("string")
    cells = F.array(F.array(F.lit("item"), F.lit("page"), F.lit("text")), F.array(cell, F.col("page").cast("string"), F.col("content")))
    items = items.withColumns({"cells": cells, "error": F.when(F.col("item_ord") % 5 == 0, F.lit("no grid"))})
    return layout.normalise_items(items).select("doc_id", "item_ord", "content")


@query
def nested_picture_text(spark: SparkSession, d: str) -> DataFrame:
    """The texts of an order's lines as what stands inside a picture, with a caption."""
    items = layout_items(spark, d)
    text = F.when(F.col("item_ord") % 3 != 0, F.concat(F.lit("  "), F.col("content"), F.lit(" "))).otherwise(F.lit(" "))
    rows = layout.nested_text(items.select(F.col("doc_id").alias("picture_id"), F.col("item_ord").alias("child_ord"), text.alias("text")))
    return rows.select("picture_id", F.md5("text").alias("digest"), layout.caption(F.left("text", F.lit(8))).alias("caption"))


@query
def picture_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pictures: the cache holds those of even keys; the stand-in for the model describes a picture by its size, and every seventh not at all."""
    p = table(spark, d, "part").select("p_partkey", F.encode(F.concat("p_brand", "p_type"), "utf-8").alias("image"))
    known = p.filter(F.col("p_partkey") % 2 == 0).groupBy(F.sha2("image", 256).alias("digest")).agg(F.lit("held").alias("description"))

    def describe(rows: DataFrame) -> DataFrame:
        n = F.length("image")
        return rows.select("digest", F.when(n % 7 != 0, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(F.lit(" ")).alias("description"))

    return layout.with_descriptions(p, known, describe)[0].select("p_partkey", "description")


@query
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return layout.label_histogram(layout_items(spark, d))


def _page_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Requested pages of every document, and a cache that holds those of even page numbers."""
    pages = parse.parse_pages(manuals(spark, d)).select(F.col("doc_id").alias("pdf"), "page_ord", "page_num", "text")
    asked = pages.withColumn("cache_key", layout.cache_key(F.col("pdf"), F.col("page_num")))
    return asked, asked.filter(F.col("page_num") % 2 == 0)


@query
def page_cache_miss(spark: SparkSession, d: str) -> DataFrame:
    asked, cache = _page_tables(spark, d)
    return layout.missing_pages(asked, cache).select("pdf", "page_num", "cache_key")


@query
def page_write_through(spark: SparkSession, d: str) -> DataFrame:
    """The pages that the cache lacked as they are written to it; the stand-in for the recognition fails on every third page number."""
    asked, held = _page_tables(spark, d)
    cache = held.select("cache_key", F.col("text").alias("content")).dropDuplicates(["cache_key"])

    def extract(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cache_key").agg(F.min(F.when(F.col("page_num") % 3 != 0, F.concat(F.lit("Sure, here it is\n"), F.col("text")))).alias("text"))

    new = layout.extracted_pages(asked, cache, extract)[1]
    return new.select("cache_key", F.md5("content").alias("digest"), F.contains("content", F.lit(layout.FAILED)).alias("failed"))


@query
def combined_document(spark: SparkSession, d: str) -> DataFrame:
    asked, _ = _page_tables(spark, d)
    content = layout.normalise_page(F.col("text"), F.col("page_num"))
    doc = layout.combined_document(asked.select("pdf", F.col("page_ord").alias("page_num"), content.alias("content")))
    return doc.select("pdf", F.md5("content").alias("digest"), "with_marker")


# --- questions -------------------------------------------------------------------------------------------------------------------


@query
def roman_urdu_flag(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("qid", understand.is_roman_urdu(F.col("text")).alias("roman_urdu"))


@query
def keyword_router(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("qid", chat.route(F.col("text")).alias("topic"))


@query
def understanding_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies written out of the questions' own columns, every fifth of them broken, in fences or bare."""
    q = questions(spark, d)
    n = F.regexp_extract("qid", r"(\d+)$", 1).cast("int")
    body = F.to_json(
        F.struct(
            F.lit(" ").alias("translated_query"), F.col("language"), F.array(F.lit(" e 1"), F.lit("")).alias("error_codes"), F.array(F.lit(" ab-2 ")).alias("model_names"),
            F.col("intent"), F.col("product_category"), F.col("confidence"),
        )
    )
    reply = F.when(n % 5 == 0, F.lit("no object")).when(n % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    u = q.select("qid", understand.understanding(F.col("text"), reply).alias("u"))
    return u.select(
        "qid", "u.translated_query", "u.language", "u.is_roman_urdu", F.array_join("u.error_codes", ",").alias("codes"), F.array_join("u.model_names", ",").alias("models"),
        "u.intent", "u.product_category", rounded("u.confidence").alias("confidence"),
    )


# --- conversations ---------------------------------------------------------------------------------------------------------------


@query
def latest_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.latest_conversations(table(spark, d, "conversations"))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")})


@query
def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.listed(table(spark, d, "conversations"), table(spark, d, "messages"))
    return rows.select("id", "title", "page", F.size("messages").alias("messages"), F.array_join(F.transform("messages", lambda m: m["id"]), ",").alias("message_ids"))


@query
def conversation_newest(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.newest_first(chat.latest_conversations(table(spark, d, "conversations")))
    return rows.select("id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query
def conversation_point_read(spark: SparkSession, d: str) -> DataFrame:
    """Asked for by the ids that messages name, and by one of another form."""
    asked = table(spark, d, "messages").select(F.col("conversation_id").alias("id")).filter("id is not null").union(spark.sql("SELECT 'no-such-id'"))
    return chat.point_read(table(spark, d, "conversations"), asked).select("id", "found", "title")


def _new_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select(F.col("qid").alias("id"))


@query
def conversation_create(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.created(_new_ids(spark, d), F.lit("2025-01-02 03:04:05").cast("timestamp"))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")})


@query
def conversation_rename(spark: SparkSession, d: str) -> DataFrame:
    """Renamed by their messages' texts, the last of which wins."""
    m = chat.distinct_messages(table(spark, d, "messages")).filter("conversation_id is not null and text is not null and created_at is not null")
    renames = m.select(F.col("conversation_id").alias("id"), F.left("text", F.lit(20)).alias("title"), F.col("created_at").alias("at"))
    rows = chat.renamed(chat.latest_conversations(table(spark, d, "conversations")), renames)
    return rows.select("id", "title", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Two turns for each conversation, and for one that does not exist; every third question has no source, and every fourth is blank or fails."""
    ids = chat.latest_conversations(table(spark, d, "conversations")).select(F.col("id").alias("conversation_id")).union(spark.sql("SELECT 'no-such-id'"))
    n = F.pmod(F.conv(F.left(F.md5("conversation_id"), F.lit(6)), 16, 10).cast("long") + F.col("turn"), F.lit(12))
    rows = ids.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("n", n)
    source = F.struct(F.lit("T").alias("title"), F.lit(1).alias("page"), F.lit("s").alias("section"), F.lit("d").alias("documentType"), F.lit("u").alias("url"))
    sources = F.when(F.col("n") % 3 != 0, F.array(source)).otherwise(F.array().cast(SOURCES))
    question = F.concat(F.lit("question "), F.col("turn").cast("string"), F.lit(" of a rather long conversation"))
    at = F.timestamp_seconds(1_800_000_000 + F.col("turn"))
    return rows.select("conversation_id", "turn", "n", question.alias("question"), F.lit("answer").alias("answer"), sources.alias("sources"), at.alias("at"))


@query
def chat_append_turns(spark: SparkSession, d: str) -> DataFrame:
    conv, msgs = chat.latest_conversations(table(spark, d, "conversations")), table(spark, d, "messages")
    after, added = chat.append_turns(conv, msgs, _turns(spark, d))
    counts = added.groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("added"), F.count_if("is_empty").alias("empty"))
    return after.join(counts, "id", "left").select("id", "title", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "added", "empty")


@query
def chat_client_view(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    text = F.when(F.col("n") % 4 != 0, F.col("question")).otherwise(F.lit("  "))
    events = t.select("conversation_id", F.col("turn").alias("seq"), text.alias("text"), "answer", "sources", (F.col("n") % 4 == 1).alias("failed"))
    shown = chat.client_messages(events).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if("is_error").alias("errors"), F.count_if("is_empty").alias("empty"))
    return shown.join(chat.client_titles(events), "conversation_id", "left")


@query
def flag_migration(spark: SparkSession, d: str) -> DataFrame:
    old = chat.distinct_messages(table(spark, d, "messages")).select("id", F.initcap(F.col("is_empty").cast("string")).alias("is_empty"))
    return chat.with_boolean_flag(old)


@query
def conversation_titles(spark: SparkSession, d: str) -> DataFrame:
    return chat.first_titles(table(spark, d, "messages"))


@query
def message_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.mapped_messages(chat.distinct_messages(table(spark, d, "messages")))
    return rows.select("id", "role", "text", F.size("sources").alias("sources"), "is_empty", "is_error", "created_at")


@query
def feedback_last_write(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "messages").select(F.col("id").alias("message_id"), "feedback", F.col("created_at").alias("at"))
    return chat.last_feedback(log)


@query
def conversation_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Without the conversations that still have the default title."""
    conv, msgs = chat.latest_conversations(table(spark, d, "conversations")), chat.distinct_messages(table(spark, d, "messages"))
    _, left = chat.deleted(conv, msgs, conv.filter(F.col("title") == chat.DEFAULT_TITLE))
    return left.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"))


@query
def valid_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.valid_messages(chat.distinct_messages(table(spark, d, "messages")))
    sound = chat.valid_id(F.col("id"))
    return rows.select("id", F.lower(F.trim("role")).alias("role"), sound.alias("valid_id"), chat.tone(F.lit(False), F.col("is_empty")).alias("tone"))
