from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators import layout
from lodestone.schemas import LAYOUT_ITEMS


def items(spark, boxes, page=1):
    rows = [("d", i, 1, "text", "text", page, f"t{i}", None if b is None else dict(zip("ltrb", map(float, b), strict=True))) for i, b in enumerate(boxes, 1)]
    return spark.createDataFrame(rows, LAYOUT_ITEMS)


def order(spark, boxes):
    return [r["item_ord"] for r in layout.reading_order(items(spark, boxes)).orderBy("reading_order").collect()]


def test_two_columns(spark):
    # left, top, right, bottom; the right column's boxes come first in the file
    assert order(spark, [(300, 700, 500, 600), (300, 590, 500, 500), (10, 700, 200, 605), (10, 595, 200, 500), None]) == [3, 4, 1, 2, 5]


def test_rows_before_columns_when_the_gap_is_larger(spark):
    assert order(spark, [(0, 100, 40, 90), (50, 100, 90, 90), (0, 40, 40, 30), (50, 40, 90, 30)]) == [1, 2, 3, 4]


def test_order_is_a_permutation(spark):
    rng = random.Random(2)
    boxes = []
    for _ in range(40):
        x, y = rng.uniform(0, 500), rng.uniform(0, 700)
        boxes.append((x, y + rng.uniform(1, 60), x + rng.uniform(1, 90), y))
    assert sorted(order(spark, boxes)) == list(range(1, 41))


def test_gaps(spark):
    spans = [(0, 2), (1, 3), (3, 4), (6.5, 8), (7, 7.5), (12, 13)]
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in spans], "k string, lo double, hi double")
    assert [(r["lo"], r["hi"]) for r in layout.gaps(df, ["k"]).orderBy("lo").collect()] == [(4.0, 6.5), (8.0, 12.0)]


def value(spark, column, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    return df.select(column.alias("v")).first()["v"]


def test_garbage(spark):
    for text, want in (("E", True), ("--a-", True), ("a-b", False), ("m²", False), ("  ", True)):
        assert value(spark, layout.is_garbage(F.col("t")), t=text) is want


def test_cleaning(spark):
    assert value(spark, layout.clean_ocr(F.col("t")), t="Gross  Welght of the Cablnet, INTERNAL") == "Gross Weight of the Cabinet, Internal"
    assert value(spark, layout.clean_ocr(F.col("t")), t="") == ""


def test_picture_text(spark):
    v = value(spark, layout.picture_content(F.lit(" Fig 1 "), F.lit(None).cast("string"), F.lit(" x ")))
    assert v == "[CAPTION] Fig 1\n[TEXT IN IMAGE] x"
    assert value(spark, layout.picture_content(*[F.lit(None).cast("string")] * 3)) == layout.NOTHING


def test_pages(spark):
    assert value(spark, layout.normalise_page(F.lit("Here is the extracted content:\n\n# A"), F.lit(4))) == "## PAGE 4\n\n# A"
    assert value(spark, layout.normalise_page(F.lit("## PAGE 9\nx"), F.lit(4))) == "## PAGE 9\nx"
    assert tuple(value(spark, layout.page_range(F.lit("3-99"), F.lit(10)))) == (3, 10)
    assert tuple(value(spark, layout.page_range(F.lit("3"), F.lit(10)))) == (1, 10)


def test_cache_misses(spark):
    asked = spark.createDataFrame([("a", 1), ("a", 2)], "pdf string, page_num int").withColumn("cache_key", layout.cache_key(F.col("pdf"), F.col("page_num")))
    assert [r["page_num"] for r in layout.missing_pages(asked, asked.filter("page_num = 1")).collect()] == [2]
