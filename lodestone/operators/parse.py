"""Raw manuals to pages, sections and typed chunks.

A manual is one string and so one row; everything below it is keyed by the manual. Windows run inside a manual only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import newlines, strip, words
from lodestone.operators.extract import chunk_metadata

#: Fixed values of the page and chunk format.
PAGE_MARKER = r"^\s*(?:#{1,6}\s+)?PAGE\s+(\d+)\s*$"
HEADING = r"^(#{1,6})\s+(.*)$"
TITLE_SUFFIX = r"\s*\(Cont(?:i|inue)?\.{1,}\)"
CONTINUATION = r"Cont(?:i|inue)?\.{2,}"
DIVIDER_WORDS = 15
SECTION_WORDS = 3
CHUNK_CHARS = 4000


def parse_pages(manuals: DataFrame) -> DataFrame:
    """``(doc_id, page_ord, page_num, text)``: what stands behind each page marker. Text before the first marker is dropped, and a
    manual without markers has no pages. A marker may stretch over line ends; equal page numbers stay separate pages."""
    marker = "(?dmi)" + PAGE_MARKER
    raw = newlines(F.col("raw"))
    parts = manuals.select(
        "doc_id", F.regexp_extract_all(raw, F.lit(marker), F.lit(1)).alias("nums"), F.split(raw, marker).alias("bodies")
    )
    zipped = F.arrays_zip(F.col("nums").alias("num"), F.slice("bodies", 2, F.greatest(F.size("bodies") - 1, F.lit(1))).alias("body"))
    pages = parts.filter(F.size("nums") > 0).select("doc_id", F.posexplode(zipped).alias("page_ord", "p"))
    return pages.select("doc_id", "page_ord", F.expr("try_cast(p.num AS int)").alias("page_num"), strip(F.col("p.body")).alias("text"))


def is_divider(text: Column) -> Column:
    """No table line, and fewer than 15 words outside heading lines."""
    lines = F.transform(F.split(text, "\n"), strip)
    table = F.exists(lines, lambda x: F.startswith(x, F.lit("|")))
    body = F.filter(lines, lambda x: (x != "") & ~F.rlike(x, F.lit(r"^#{1,6}\s+")))
    return ~table & (F.size(words(F.array_join(body, " "))) < DIVIDER_WORDS)


def clean_continuations(pages: DataFrame) -> DataFrame:
    """Remove the title suffix, note a bare continuation mark, remove it, and strip - in this order."""
    bare = F.regexp_replace("text", TITLE_SUFFIX, "")
    cleaned = strip(F.regexp_replace(bare, CONTINUATION, ""))
    return pages.withColumns({"has_cont": F.rlike(bare, F.lit(CONTINUATION)), "text": cleaned})


def page_lines(pages: DataFrame) -> DataFrame:
    lines = pages.select("doc_id", "page_ord", "page_num", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.filter(~F.rlike(strip(F.col("line")), F.lit(r"^@@PAGE:(\d+)@@")))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    return lines.withColumns({"level": level, "heading": strip(F.regexp_extract("line", HEADING, 2))})


def heading_sections(pages: DataFrame) -> DataFrame:
    """``(doc_id, section, heading_path, content, pages)``: the stretches between headings under their path of open headings.

    A heading closes deeper ones; a heading without content gives no section. Headings count on the line as it stands.
    """
    w = Window.partitionBy("doc_id").orderBy("page_ord", "line_no")
    lines = page_lines(pages)
    opened = {"section": F.sum((F.col("level") > 0).cast("int")).over(w)}
    for n in range(1, 7):
        state = F.when(F.col("level") == n, F.struct(F.col("heading").alias("h"))).when(
            (F.col("level") > 0) & (F.col("level") < n), F.struct(F.lit(None).cast("string").alias("h"))
        )
        opened[f"_h{n}"] = F.last(state, ignorenulls=True).over(w)
    path = F.filter(F.array(*[F.col(f"_h{n}.h") for n in range(1, 7)]), lambda x: x.isNotNull())
    lines = lines.withColumns(opened).withColumn("heading_path", path)
    ordered = F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("page_ord", "line_no", "line"))))
    sections = lines.groupBy("doc_id", "section").agg(
        F.first("heading_path").alias("heading_path"),
        strip(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("content"),
        F.sort_array(F.collect_set("page_num")).alias("pages"),
    )
    return sections.filter(F.col("content") != "")


def merge_sections(sections: DataFrame) -> DataFrame:
    """Neighbouring sections of one path become one: contents joined by an empty line, pages united."""
    w = Window.partitionBy("doc_id").orderBy("section")
    new = F.coalesce((F.lag("heading_path").over(w) != F.col("heading_path")).cast("int"), F.lit(1))
    islands = sections.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    parts = F.sort_array(F.collect_list(F.struct("section", "content", "pages")))
    merged = islands.groupBy("doc_id", "island").agg(F.first("heading_path").alias("heading_path"), parts.alias("parts"))
    return merged.select(
        "doc_id", F.col("island").alias("section"), "heading_path",
        F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n").alias("content"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("parts", lambda x: x["pages"])))).alias("pages"),
    )


def is_flowchart(text: Column) -> Column:
    def has(p: str) -> Column:
        return F.rlike(text, F.lit(p))

    helper = has(r"(?i)\bCheck\b") | has("→|↓|->") | has(r"(?i)\bReplace\b") | has(r"(?i)\bwhether\b")
    return has("(?i)Flowchart") | (has(r"(?i)\bYes\b") & has(r"(?i)\bNo\b") & helper)


def content_type(text: Column) -> Column:
    """The first that holds: warranty, error code table, table, installation, text."""
    table = F.rlike(text, F.lit(r"\|[\s\-:|]+\|"))
    return (
        F.when(F.rlike(text, F.lit("(?i)warranty")), "warranty")
        .when(table & F.rlike(text, F.lit(r"(?i)error\s*code|\bfault\b|failure")), "error_code_table")
        .when(table, "spec_table")
        .when(F.rlike(text, F.lit(r"(?i)installation|installing|\binstall\b")), "installation_sop")
        .otherwise("text")
    )


def pack_paragraphs(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Paragraphs packed greedily: a new part begins where the running length, counting two for each gap, and the next one pass the limit.

    One paragraph beyond the limit stays whole.
    """
    kind = "struct<done:array<string>,open:string,size:int>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        full = acc["open"].isNotNull() & (acc["size"] + F.length(p) > limit)
        fresh = acc["open"].isNull() | full
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(fresh, p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p)).alias("open"),
            (F.when(full, 0).otherwise(acc["size"]) + F.length(p) + 2).cast("int").alias("size"),
        ).cast(kind)

    return F.aggregate(
        F.split(text, "\n{2,}"), start, step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
    )


def route_sections(sections: DataFrame) -> DataFrame:
    """Add ``content_type`` and ``parts``: none under three words, flowcharts, tables and warranties whole, other long text packed."""
    flow = is_flowchart(F.col("content"))
    kind = F.when(flow, "troubleshooting_flow").otherwise(content_type(F.col("content")))
    rows = sections.withColumn("content_type", kind)
    whole = F.col("content_type").isin("troubleshooting_flow", "spec_table", "error_code_table", "warranty")
    parts = (
        F.when(F.size(words(F.col("content"))) < SECTION_WORDS, F.array().cast("array<string>"))
        .when(whole | (F.length("content") <= CHUNK_CHARS), F.array("content"))
        .otherwise(pack_paragraphs(F.col("content")))
    )
    return rows.withColumn("parts", parts)


def chunks_of(routed: DataFrame, series: list[str] | tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """``(doc_id, chunk_no, chunk_id, text, metadata)``, numbered inside each manual."""
    rows = routed.select("doc_id", "section", "heading_path", "pages", "content_type", F.posexplode("parts").alias("part", "body"))
    rows = rows.withColumn("text", strip(F.regexp_replace("body", "\n{3,}", "\n\n")))
    rows = rows.withColumn("title", F.array_join("heading_path", " > "))
    rows = rows.withColumn("metadata", chunk_metadata(series))
    w = Window.partitionBy("doc_id").orderBy("section", "part")
    rows = rows.withColumn("chunk_no", F.row_number().over(w))
    name = F.format_string("%s%s_%04d", F.lit(prefix), F.col("doc_id"), F.col("chunk_no"))
    return rows.select("doc_id", "chunk_no", name.alias("chunk_id"), "text", "metadata")


def sections_of(manuals: DataFrame) -> DataFrame:
    pages = parse_pages(manuals)
    return merge_sections(heading_sections(clean_continuations(pages.filter(~is_divider(F.col("text"))))))


def parse_manuals(manuals: DataFrame, series: list[str] | tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Raw manuals to chunks in one lazy plan."""
    return chunks_of(route_sections(sections_of(manuals)), series, prefix)


def ingest_report(manuals: DataFrame, series: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row for each manual: the counts of every step."""
    pages = parse_pages(manuals).withColumn("divider", is_divider(F.col("text")))
    kept = clean_continuations(pages.filter(~F.col("divider")))
    raw = heading_sections(kept)
    routed = route_sections(merge_sections(raw))
    chunks = chunks_of(routed, series)

    def nums(flag: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col(flag), F.struct("page_ord", "page_num"))))
        return F.transform(rows, lambda x: x["page_num"])

    return (
        manuals.select("doc_id").distinct()
        .join(pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages_parsed"), nums("divider").alias("divider_pages_removed")), "doc_id", "left")
        .join(kept.groupBy("doc_id").agg(nums("has_cont").alias("continuation_marker_pages")), "doc_id", "left")
        .join(page_lines(kept).groupBy("doc_id").agg(F.count_if(F.col("level") > 0).alias("headings_detected")), "doc_id", "left")
        .join(raw.groupBy("doc_id").agg(F.count(F.lit(1)).alias("raw_chunks_before_merge")), "doc_id", "left")
        .join(routed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections_after_merge"), F.count_if(F.size("parts") == 0).alias("tiny_fragments_skipped")), "doc_id", "left")
        .join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks")), "doc_id", "left")
    )
