"""Post-processing of page layout and recognition results: cleaning, filters, reading order and rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import any_of, blank_to_null, strip

#: Systematic misreadings and what they are rewritten to, in the order in which they apply, whatever the case.
OCR_RULES: tuple[tuple[str, str], ...] = (
    (r"\b11OO\b", "1100"), (r"\b11[oO][oO]\b", "1100"), (r"\b14OO\b", "1400"), (r"\b14[oO][oO]\b", "1400"),
    (r"\bVoltaee\b", "Voltage"), (r"\bVoltaee/Frequency\b", "Voltage/Frequency"), (r"\bWelght\b", "Weight"), (r"\bGross\s+Welght\b", "Gross Weight"),
    (r"\bNet\s+Welght\b", "Net Weight"), (r"\bConsumptlon\b", "Consumption"), (r"\bPower\s+Consumptlon\b", "Power Consumption"),
    (r"\bCurrent\s+Consumptlon\b", "Current Consumption"), (r"\bMechankcal\b", "Mechanical"), (r"\bNatujal\b", "Natural"), (r"\bAvallable\b", "Available"),
    (r"\bClmate\b", "Climate"), (r"\bDefrostine\b", "Defrosting"), (r"\bHeleht\b", "Height"), (r"\bCablnet\b", "Cabinet"), (r"\bWlthout\b", "Without"),
    (r"\bWlre\b", "Wire"), (r"\bChlld\b", "Child"), (r"\bLockwlth\b", "Lock with"), (r"\bKex\b", "Key"), (r"\bHumldlty\b", "Humidity"),
    (r"\bHumldity\b", "Humidity"), (r"\bRefrlgerator\b", "Refrigerator"), (r"\bRefrleerant\b", "Refrigerant"), (r"\bEvaporator\b", "Evaporator"),
    (r"\bCondenser\b", "Condenser"), (r"\bCoollng\b", "Cooling"), (r"\bFreezine\b", "Freezing"), (r"\bAdjustable\b", "Adjustable"),
    (r"\bTemperature\s+Control\b", "Temperature Control"), (r"\bStart\s+Rating\b", "Star Rating"), (r"\bUters\b", "Liters"), (r"\bLlters\b", "Liters"),
    (r"\bLters\b", "Liters"), (r"\bLiters\b", "Liters"), (r"\bAmperes\b", "Ampere"), (r"\bAm pere\b", "Ampere"), (r"\bAmpere\b", "Ampere"),
    (r"\b@99\s*O\s*0\b", "99.9%"), (r"\b@99\.9%\b", "99.9%"), (r"\bRGOOa\b", "R600a"), (r"\bR134a\b", "R134a"), (r"\bRoll\s+Bonu\b", "Roll Bond"),
    (r"\bTube\s+on\s+Shcet\b", "Tube on Sheet"), (r"\bUnlts\b", "Units"), (r"\bDESCRIPTION\b", "Description"), (r"\bPERFORMANCE\b", "Performance"),
    (r"\bGENERAL FEATURES\b", "General Features"), (r"\bDIMENSIONS\b", "Dimensions"), (r"\bWEIGHT\b", "Weight"), (r"\bINTERNAL\b", "Internal"),
    (r"\bCAPACITY\b", "Capacity"), (r"\bFreezer\s*\n\s*Capacity\b", "Freezer Capacity"), (r"\bRefrigerator\s*\n\s*Capacity\b", "Refrigerator Capacity"),
    (r"\bChlld\s+Lockwlth\s+Kex\b", "Child Lock with Key"), (r"\bShelves\s+Type\b", "Shelves Type"),
)
TABLE_WORDS = ("specification", "technical", "dimension", "capacity", "voltage", "power consumption", "weight", "model", "table", "description")
LINE_CONFIDENCE, PICTURE_AREA, RECOGNISED_CHARS, CONTEXT_CHARS, ACCEPTABLE_CHARS = 0.5, 16900, 250, 600, 20
SHORT_SIDE, LARGEST_SCALE = 640, 3.0
BULLETS = ("-", "*", "➢", "❑", "•")
NOTHING = "[No extractable content found in image]"


def clean_ocr(text: Column, rules: tuple[tuple[str, str], ...] = OCR_RULES) -> Column:
    """The rules in order, then runs of spaces made one. Further rules of a product line are passed by the caller.

    Most texts hold nothing that any rule changes: one search tells, and the rules are tried on the others only.
    """
    any_rule = "|".join(["(?i:" + pattern + ")" for pattern, _ in rules] + [" {2,}"])
    cleaned = text
    for pattern, replacement in rules:
        cleaned = F.regexp_replace(cleaned, "(?i)" + pattern, replacement)
    return F.when(F.rlike(text, F.lit(any_rule)), F.regexp_replace(cleaned, " {2,}", " ")).otherwise(text)


def is_garbage(text: Column) -> Column:
    """Under two characters, or under 40 % letters and digits."""
    s = strip(text)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))
    return (F.length(s) < 2) | (letters / F.greatest(F.length(s), F.lit(1)) < 0.4)


def recognised_text(lines: DataFrame, key: str = "image_id") -> DataFrame:
    """``(key, text, confidence, dropped)`` out of ``(key, line_ord, text, score)``: sure and sensible lines in order, their mean score."""
    rows = lines.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    good = (F.col("score") >= LINE_CONFIDENCE) & ~is_garbage(F.col("text"))
    kept = F.sort_array(F.collect_list(F.when(good, F.struct("line_ord", "text"))))
    return rows.groupBy(key).agg(
        F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"),
        F.coalesce(F.avg(F.when(good, F.col("score"))), F.lit(0.0)).alias("confidence"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"),
    )


def upscaled(width: Column, height: Column) -> Column:
    """``(width, height)`` after enlarging a small picture so that its short side has 640 pixels, three times at most."""
    short = F.least(width, height)
    scale = F.least(F.lit(LARGEST_SCALE), F.greatest(F.lit(1.0), SHORT_SIDE / short))
    grown = (short > 0) & (scale > 1.05)
    return F.struct(
        F.when(grown, (width * scale).cast("int")).otherwise(width).alias("width"),
        F.when(grown, (height * scale).cast("int")).otherwise(height).alias("height"),
    )


def likely_table(context: Column) -> Column:
    return any_of(F.lower(F.coalesce(context, F.lit(""))), TABLE_WORDS)


def needs_description(width: Column, height: Column, nested: Column, recognised: Column, mode: str = "auto") -> Column:
    """Whether a picture goes to the describing model: never when off or missing or small; always, or when little text was recognised."""
    if mode == "off":
        return F.lit(False)
    present = width.isNotNull() & height.isNotNull() & (width * height >= PICTURE_AREA)
    if mode == "always":
        return F.coalesce(present, F.lit(False))
    size = F.length(strip(F.coalesce(nested, F.lit("")))) + F.length(strip(F.coalesce(recognised, F.lit(""))))
    return F.coalesce(present & (size < RECOGNISED_CHARS), F.lit(False))


def best_text(nested: Column, recognised: Column, confidence: Column) -> Column:
    """``(text, source, confidence)``: the longer recognition wins; the embedded text if it is long enough; else what there is."""
    n, r = F.coalesce(nested, F.lit("")), F.coalesce(recognised, F.lit(""))
    sure = F.when(strip(r) != "", F.round(confidence, 3))
    longer = F.length(strip(r)) > F.length(strip(n))
    enough = F.length(strip(n)) >= ACCEPTABLE_CHARS
    return F.struct(
        F.when(longer, r).when(enough, n).otherwise(F.coalesce(blank_to_null(r), n)).alias("text"),
        F.when(longer, "recognised").when(enough, "nested").when(strip(r) != "", "recognised").when(strip(n) != "", "nested").otherwise("none").alias("source"),
        F.when(longer, sure).when(enough, F.lit(None).cast("double")).otherwise(sure).alias("confidence"),
    )


def picture_content(caption: Column, description: Column, text: Column) -> Column:
    """Caption, description and text of a picture as tagged lines, or a placeholder."""
    parts = F.concat_ws(
        "\n",
        F.concat(F.lit("[CAPTION] "), F.nullif(clean_ocr(strip(caption)), F.lit(""))),
        F.concat(F.lit("[IMAGE DESCRIPTION] "), blank_to_null(description)),
        F.concat(F.lit("[TEXT IN IMAGE] "), blank_to_null(strip(text))),
    )
    # each written once: the rules of cleaning make long code
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit(NOTHING))


def gaps(intervals: DataFrame, keys: list[str], low: str = "lo", high: str = "hi") -> DataFrame:
    """``(keys, lo, hi)`` of the open gaps between the united intervals of a group; touching ones unite."""
    w = Window.partitionBy(*keys).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    seen = intervals.withColumn("_reach", F.max(high).over(w)).filter(F.col(low) > F.col("_reach"))
    return seen.select(*keys, F.col("_reach").alias("lo"), F.col(low).alias("hi"))


class _Cutter:
    """Recursive cutting of one page's boxes at the widest empty strip; the origin is at the lower left."""

    def __init__(self, boxes: list[tuple], least: float, deepest: int) -> None:
        self.boxes, self.least, self.deepest = boxes, least, deepest

    def strip(self, of: list[int], lo: int, hi: int) -> tuple[float, float] | None:
        spans = sorted((self.boxes[i][lo], self.boxes[i][hi]) for i in of)
        best, reach = None, spans[0][1]
        for a, b in spans[1:]:
            if a - reach >= self.least and (best is None or a - reach > best[1] - best[0]):
                best = (reach, a)
            reach = max(reach, b)
        return best

    def parts(self, of: list[int], strip: tuple[float, float] | None, level: bool) -> tuple[list[int], list[int]] | None:
        if strip is None:
            return None
        middle = (strip[0] + strip[1]) / 2
        if level:
            first, second = [i for i in of if self.boxes[i][3] >= middle], [i for i in of if self.boxes[i][1] <= middle]
        else:
            first, second = [i for i in of if self.boxes[i][2] <= middle], [i for i in of if self.boxes[i][0] >= middle]
        return (first, second) if first and second and max(len(first), len(second)) < len(of) else None

    def order(self, of: list[int], depth: int = 0) -> list[int]:
        if len(of) <= 1:
            return of
        if depth < self.deepest:
            rows, columns = self.strip(of, 3, 1), self.strip(of, 0, 2)
            wide = columns[1] - columns[0] if columns else -1
            high = rows[1] - rows[0] if rows else -1
            tries = [(rows, True), (columns, False)]
            for strip, level in tries if rows and high >= wide else tries[::-1]:
                if cut := self.parts(of, strip, level):
                    return self.order(cut[0], depth + 1) + self.order(cut[1], depth + 1)
        return sorted(of, key=lambda i: (-self.boxes[i][1], self.boxes[i][0]))


def reading_order(items: DataFrame, least: float = 3.0, deepest: int = 25) -> DataFrame:
    """Layout items with ``reading_order`` from 1 in each document: pages as they first appear, boxes by cutting, items without box last.

    The cutting is recursive over one page's boxes; a page is the group, and its number of boxes is that of a printed page.
    """
    corners = F.sort_array(F.collect_list(F.struct("item_ord", "bbox.l", "bbox.t", "bbox.r", "bbox.b")))
    boxed = items.filter(F.col("bbox").isNotNull()).groupBy("doc_id", "page").agg(corners.alias("boxes"))
    kind = items.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ords, places = [], [], []
            for doc, boxes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sides = [(x["l"], x["t"], x["r"], x["b"]) for x in boxes]
                for place, i in enumerate(_Cutter(sides, least, deepest).order(list(range(len(sides))))):
                    docs.append(doc)
                    ords.append(boxes[i]["item_ord"])
                    places.append(place)
            types = [batch.schema.field(0).type, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((docs, ords, places), types, strict=True)], names=["doc_id", "item_ord", "place"])

    placed = boxed.select("doc_id", "boxes").mapInArrow(cut, f"doc_id {kind}, item_ord int, place int")
    page = Window.partitionBy("doc_id", "page")
    rows = items.join(placed, ["doc_id", "item_ord"], "left").withColumn("_first", F.min("item_ord").over(page))
    w = Window.partitionBy("doc_id").orderBy("_first", F.col("place").asc_nulls_last(), "item_ord")
    return rows.withColumn("reading_order", F.row_number().over(w)).drop("_first", "place")


def page_context(items: DataFrame) -> DataFrame:
    """``(doc_id, page, context)``: the texts of a page but for pictures, a phrase for each table, cut at 600 characters."""
    table = F.lit("[a technical specification table is on this page]")
    snippet = F.when(F.col("label") == "table", table).otherwise(strip(F.coalesce(F.col("content"), F.lit(""))))
    rows = items.filter(~F.col("label").isin("picture", "image") & F.col("page").isNotNull()).withColumn("s", snippet).filter(F.col("s") != "")
    parts = F.sort_array(F.collect_list(F.struct("item_ord", "s")))
    return rows.groupBy("doc_id", "page").agg(F.left(F.array_join(F.transform(parts, lambda x: x["s"]), " | "), F.lit(CONTEXT_CHARS)).alias("context"))


def caption(text: Column) -> Column:
    """A picture's caption without outer whitespace; null for a blank one."""
    return blank_to_null(strip(text))


def nested_text(children: DataFrame, key: str = "picture_id") -> DataFrame:
    """``(key, text)`` out of ``(key, child_ord, text)``: the texts inside a picture that are not blank, one a line, in order."""
    rows = children.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    parts = F.sort_array(F.collect_list(F.struct("child_ord", "text")))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def with_descriptions(pictures: DataFrame, cache: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``pictures`` with their ``description``, and the new rows ``(digest, description)`` of the cache.

    A picture is known by the SHA-256 of its bytes (column ``image``). ``describe`` is the model, outside of the plan: ``(digest, image)`` in, each
    distinct picture that the cache lacks once, ``(digest, description)`` out. Blank descriptions are none and are not cached.
    """
    keyed = pictures.withColumn("digest", F.sha2("image", 256))
    lacking = keyed.filter(F.col("image").isNotNull()).join(cache.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("image").alias("image"))
    new = describe(lacking).select("digest", blank_to_null(strip(F.col("description"))).alias("description")).filter(F.col("description").isNotNull())
    known = cache.select("digest", blank_to_null(strip(F.col("description"))).alias("description")).unionByName(new)
    return keyed.join(known, "digest", "left").drop("digest"), new


def markdown_table(cells: Column) -> Column:
    """A pipe table out of rows of cells, the first of which is the head."""

    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.repeat(F.lit(":---|"), F.size(F.element_at(cells, 1))))
    rows = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), line)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(line(F.element_at(cells, 1)), rule), rows), "\n"))


PARTIAL = "[TABLE EXTRACTION PARTIAL — fallback text]"


def normalise_items(items: DataFrame) -> DataFrame:
    """Box corners to two places, the type from the label, and cleaned contents.

    A table's content is its ``cells`` as a pipe table where that column is given; with an ``error``, or without cells beside one, its text under a
    line that says so and before the error. A picture's content stays as it was put together.
    """
    b = F.col("bbox")
    box = F.when(b.isNotNull(), F.struct(*[F.round(b[k], 2).alias(k) for k in ("l", "t", "r", "b")]))
    kind = F.when(F.col("label") == "table", "table").when(F.col("label").isin("picture", "image"), "image").otherwise("text")
    content = F.col("content")
    if "cells" in items.columns:
        drawn = markdown_table(F.col("cells"))
        if "error" in items.columns:
            failed = F.concat(F.lit(PARTIAL + "\n"), F.coalesce(content, F.lit("")), F.lit("\n[Error: "), F.col("error"), F.lit("]"))
            drawn = F.when(F.col("error").isNotNull(), failed).otherwise(drawn)
        content = F.when(F.col("label") == "table", F.coalesce(drawn, content)).otherwise(content)
    cleaned = F.when(kind == "image", content).otherwise(clean_ocr(content))
    return items.withColumns({"bbox": box, "type": kind, "content": cleaned})


def rendered(items: DataFrame, order: str = "reading_order") -> DataFrame:
    """Each item with ``new_page``, its ``markdown`` and its ``flat`` text."""
    w = Window.partitionBy("doc_id").orderBy(order)
    before = F.lag("page").over(w)
    new = (F.row_number().over(w) == 1) & F.col("page").isNotNull() | ~before.eqNullSafe(F.col("page")) & (F.row_number().over(w) > 1)
    label, level, content = F.lower(F.coalesce("label", F.lit(""))), F.coalesce("level", F.lit(0)), F.coalesce("content", F.lit(""))
    depth = F.least(F.lit(6), F.greatest(F.lit(1), level + 1))
    indent = F.repeat(F.lit("  "), F.greatest(F.lit(0), level - 1))
    bullet = F.left(F.regexp_replace(content, r"(?U)^\s+", ""), F.lit(1)).isin(*BULLETS)
    markdown = (
        F.when(label.isin("section_header", "heading", "title"), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), content, F.lit("\n\n")))
        .when(label.isin("list_item", "bullet", "list"), F.concat(indent, F.when(bullet, F.lit("")).otherwise(F.lit("- ")), content, F.lit("\n")))
        .when(F.col("type") == "image", F.concat(F.lit("**[IMAGE]**\n\n"), content, F.lit("\n\n")))
        .otherwise(F.concat(content, F.lit("\n\n")))
    )
    flat = F.concat(F.lit("["), F.upper("label"), F.lit(" | level="), level.cast("string"), F.lit("]\n"), content, F.lit("\n"))
    return items.withColumns({"new_page": new, "markdown": markdown, "flat": flat})


def rendered_documents(items: DataFrame, order: str = "reading_order") -> DataFrame:
    """``(doc_id, markdown, flat)``: a document is one value here, as it is in the file that it is written to."""
    rows = rendered(items, order)
    page = F.col("page").cast("string")
    md = F.concat(F.when(F.col("new_page"), F.concat(F.lit("\n---\n\n**PAGE "), page, F.lit("**\n\n"))).otherwise(F.lit("")), F.col("markdown"))
    bar = "=" * 70
    flat = F.concat(F.when(F.col("new_page"), F.concat(F.lit(f"\n{bar}\n--- PAGE "), page, F.lit(f" ---\n{bar}\n\n"))).otherwise(F.lit("")), F.col("flat"))

    def joined(c: Column, gap: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c.alias("x")))), lambda x: x["x"]), gap)

    return rows.groupBy("doc_id").agg(joined(md, "").alias("markdown"), joined(flat, "\n").alias("flat"))


def structured_lines(items: DataFrame, order: str = "reading_order") -> DataFrame:
    """``(doc_id, line_no, value)``: a document's structured items as JSON lines, a header with its counts first, then an item a line.

    A line is a row, so a document may have any number of items.
    """
    head = items.groupBy("doc_id").agg(F.max("page").alias("total_pages"), F.count(F.lit(1)).alias("total_items"))
    names = [c for c in items.columns if c != "doc_id"]
    first = head.select("doc_id", F.lit(0).cast("long").alias("line_no"), F.to_json(F.struct(F.col("doc_id").alias("source"), "total_pages", "total_items")).alias("value"))
    each = items.select("doc_id", F.col(order).cast("long").alias("line_no"), F.to_json(F.struct(*names)).alias("value"))
    return first.unionByName(each)


def item_summary(items: DataFrame) -> DataFrame:
    """``(doc_id, total_pages, total_items, item_breakdown)``: a count for each label of a document; labels are few."""
    by = items.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("page"))
    breakdown = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("label", F.lit("unknown")), "n"))))
    return by.groupBy("doc_id").agg(F.max("page").alias("total_pages"), F.sum("n").alias("total_items"), breakdown.alias("item_breakdown"))


def with_preamble(documents: DataFrame, facts: list[tuple[str, str]]) -> DataFrame:
    """``documents`` whose ``markdown`` starts with its name and ``facts``: (label, column) pairs, a line each."""
    lines = [F.concat(F.lit(f"**{label}:** "), F.coalesce(F.col(c).cast("string"), F.lit("None")), F.lit("  ")) for label, c in facts]
    head = F.concat(F.lit("# "), F.col("doc_id"), F.lit("\n\n"), F.concat_ws("\n", *lines), F.lit("\n\n---\n\n"))
    return documents.withColumn("markdown", F.concat(head, F.col("markdown")))


def label_histogram(items: DataFrame) -> DataFrame:
    return items.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- page cache ------------------------------------------------------------------------------------------------------------------

CHATTER = r"(?i)^(Here is the extracted content|The page contains|This page shows|Sure,? here).*?\n+"


def cache_key(pdf: Column, page: Column, dpi: int = 220, version: str = "v1") -> Column:
    return F.sha2(F.concat_ws("_", pdf, page.cast("string"), F.lit(str(dpi)), F.lit(version)), 256)


FAILED = "[ERROR] All models failed for this page."


def normalise_page(text: Column, page: Column) -> Column:
    """Without a chatty first line, and with the page's marker in front if it has none; a page without text, of which all models failed, says so."""
    body = F.regexp_replace(strip(F.coalesce(text, F.lit(FAILED))), CHATTER, "")
    return F.when(F.startswith(body, F.lit("## PAGE")), body).otherwise(F.concat(F.lit("## PAGE "), page.cast("string"), F.lit("\n\n"), body))


def page_range(spec: Column, total: Column) -> Column:
    """``(first, last)`` out of ``a-b``, the end not beyond the document; the whole document for anything else."""
    parts = F.split(F.coalesce(spec, F.lit("")), "-")
    a, b = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    sound = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    return F.struct(F.when(sound, a).otherwise(1).alias("first"), F.when(sound, F.least(b, total)).otherwise(total).alias("last"))


def missing_pages(requested: DataFrame, cache: DataFrame) -> DataFrame:
    """The requested pages that the cache lacks; failed pages count as held."""
    return requested.join(cache.select("cache_key"), "cache_key", "left_anti")


def extracted_pages(requested: DataFrame, cache: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All requested pages with their ``content``, and the new rows ``(cache_key, content)`` of the cache.

    ``extract`` is the recognition, outside of the plan: the rows of ``requested`` that the cache lacks in, ``(cache_key, text)`` out; a page that it does
    not give, or gives without text, is held as failed.
    """
    lacking = missing_pages(requested, cache)
    given = extract(lacking).select("cache_key", "text")
    new = lacking.select("cache_key", "page_num").distinct().join(given, "cache_key", "left").select("cache_key", normalise_page(F.col("text"), F.col("page_num")).alias("content"))
    held = cache.select("cache_key", "content").unionByName(new)
    return requested.join(held, "cache_key"), new


def combined_document(pages: DataFrame) -> DataFrame:
    """``(pdf, content, with_marker)``: the cached pages of a document in order, joined by line ends."""
    ordered = F.sort_array(F.collect_list(F.struct("page_num", "content")))
    return pages.groupBy("pdf").agg(
        F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("content"), F.count_if(F.startswith("content", F.lit("## PAGE"))).alias("with_marker")
    )
