"""Metadata of a chunk out of its text: models, error codes, table cells, product category and section."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import any_of, strip

#: Fixed values.
MODEL_CODE = r"\bP[A-Z]{2,9}[-\s]?\d{2,5}[A-Z0-9]{0,4}\b"
ERROR_CODE = r"\b(?:PC|EL|EH|EC|EA|EB|EE|EF|EU|FA|FC|FB|FH|PA|PE|Fb|Eb|E|F|P|L)\s?\d{1,2}[A-Z]?\b"
CODE_HEADER = r"(?i)(^\s*code\s*$|error\s*code|idu\s*display|fault\s*code)"
ERROR_TABLE = "(?i)(error|fault|failure|trouble|display)"
CELL_CODE = r"\b[A-Z]{0,2}\s?\d{1,2}[A-Z]?\b|\b5E\b"
CATEGORIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("led_television", ("led television", "led tv", "pld-", "google tv")),
    ("microwave_oven", ("microwave", "pmo", "magnetron", "convection series", "grill function")),
    ("water_dispenser", ("water dispenser", "pwd-", "pcwd")),
    ("washing_machine", ("washing machine", "pawm", "pwms", "pwm-")),
    ("deep_freezer", ("deep freezer", "pdf-", "pdint", "pvf-")),
    ("refrigerator", ("refrigerator", "prlp", "prgd", "prinv")),
    (
        "air_conditioner",
        ("air conditioner", "split ac", "inverter ac", "ac model", " idu", " odu", "id pipe sensor", "indoor unit", "outdoor unit", "compressor malfunction", "split air"),
    ),
)


def model_names(text: Column, series: list[str] | tuple[str, ...] = ()) -> Column:
    """Series names that stand in the text as whole words, all of them, and model codes; sorted and distinct."""
    upper = F.upper(text)
    codes = F.transform(F.regexp_extract_all(upper, F.lit(MODEL_CODE), F.lit(0)), strip)
    names = [F.when(F.rlike(upper, F.lit(rf"\b{re.escape(s)}\b")), F.lit(s)) for s in sorted(series)]
    if names:
        codes = F.concat(codes, F.filter(F.array(*names), lambda x: x.isNotNull()))
    return F.array_sort(F.array_distinct(codes))


def tables(text: Column) -> Column:
    """The Markdown tables of a text: ``array<array<array<string>>>`` of cells, at least two lines each, without separator rows."""
    lines = F.transform(F.split(text, "\n"), strip)
    kind = "struct<done:array<array<string>>,open:array<string>>"
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("open")).cast(kind)

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) >= 2, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        row = F.startswith(line, F.lit("|"))
        return F.struct(
            F.when(row, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(row, F.concat(acc["open"], F.array(line))).otherwise(none).alias("open"),
        ).cast(kind)

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), strip)

    def rows(table: Column) -> Column:
        parsed = F.transform(table, cells)
        return F.filter(parsed, lambda r: F.exists(r, lambda c: (c != "") & ~F.rlike(c, F.lit("^:?-{2,}:?$"))))

    found = F.transform(F.aggregate(lines, start, step, closed), rows)
    return F.filter(found, lambda t: F.size(t) > 0)


def _cell_codes(cell: Column) -> Column:
    value = strip(F.regexp_replace(cell, r"<br\s*/?>", " "))
    found = F.regexp_extract_all(value, F.lit(CELL_CODE), F.lit(0))
    plain = F.transform(found, lambda t: F.upper(F.replace(t, F.lit(" "), F.lit(""))))
    return F.filter(plain, lambda t: (t != "") & (F.length(t) <= 5))


def table_codes(text: Column) -> Column:
    """Codes from the code columns of tables whose header speaks of errors; short rows and headers naming an inverter are skipped."""

    def of(table: Column) -> Column:
        head = F.element_at(table, 1)
        wanted = F.rlike(F.array_join(head, " "), F.lit(ERROR_TABLE))

        def row(r: Column) -> Column:
            picked = F.transform(
                r,
                lambda c, i: F.when(
                    F.rlike(F.coalesce(F.get(head, i), F.lit("")), F.lit(CODE_HEADER)) & ~F.contains(F.lower(F.coalesce(F.get(head, i), F.lit(""))), F.lit("inverter")), c
                ),
            )
            return F.flatten(F.transform(F.filter(picked, lambda c: c.isNotNull()), _cell_codes))

        return F.when(wanted, F.flatten(F.transform(F.slice(table, 2, F.size(table)), row))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(tables(text), of)))


def error_codes(text: Column) -> Column:
    """Codes in the text and in code columns, in upper case without spaces; sorted and distinct."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(ERROR_CODE), F.lit(0)), lambda t: F.upper(F.replace(t, F.lit(" "), F.lit(""))))
    special = F.when(F.rlike(text, F.lit(r"\b5E\b")), F.array(F.lit("5E"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.array_union(plain, special), table_codes(text)))


def product_category(text: Column, title: Column, categories: tuple[tuple[str, tuple[str, ...]], ...] = CATEGORIES) -> Column:
    blob = F.lower(F.concat(title, F.lit("\n"), text))
    out = None
    for name, needles in categories:
        test = any_of(blob, needles)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("general")


def section_label(text: Column, kind: Column, title: Column) -> Column:
    low = F.lower(title)
    return (
        F.when(kind == "troubleshooting_flow", "troubleshooting")
        .when(kind == "error_code_table", "error_codes")
        .when(kind == "warranty", "warranty")
        .when(kind == "installation_sop", "installation")
        .when(kind == "spec_table", "specifications")
        .when(any_of(low, ("warranty",)), "warranty")
        .when(any_of(low, ("install",)), "installation")
        .when(any_of(low, ("error code", "troubleshoot", "fault")), "troubleshooting")
        .when(F.rlike(text, F.lit("(?i)troubleshoot|error code|fault")), "troubleshooting")
        .when(F.rlike(text, F.lit("(?i)install")), "installation")
        .when(F.rlike(text, F.lit("(?i)warranty")), "warranty")
        .otherwise("features")
    )


def chunk_metadata(series: list[str] | tuple[str, ...] = ()) -> Column:
    """The metadata struct out of the columns text, title, content_type and pages."""
    text, title, kind = F.col("text"), F.col("title"), F.col("content_type")
    return F.struct(
        title.alias("title"),
        F.try_element_at("pages", F.lit(1)).alias("page_start"),
        F.try_element_at("pages", F.lit(-1)).alias("page_end"),
        F.col("pages").alias("source_pages"),
        product_category(text, title).alias("product_category"),
        section_label(text, kind, title).alias("section"),
        kind.alias("content_type"),
        model_names(text, series).alias("model_names"),
        error_codes(text).alias("error_codes"),
        F.length(text).cast("int").alias("char_count"),
    )


def table_cells(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key, table_no, row_no, column_no, cell)``"""
    t = rows.select(key, F.posexplode(tables(F.col("text"))).alias("table_no", "t"))
    r = t.select(key, "table_no", F.posexplode("t").alias("row_no", "r"))
    return r.select(key, "table_no", "row_no", F.posexplode("r").alias("column_no", "cell"))
