from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import extract, parse


def pages_of(spark, raw):
    rows = parse.parse_pages(spark.createDataFrame([("d", raw)], "doc_id string, raw string")).orderBy("page_ord").collect()
    return [(r["page_num"], r["text"]) for r in rows]


def test_markers_cross_lines_and_bold_is_text(spark):
    assert pages_of(spark, "intro\n## PAGE 1\na\nPAGE\n5\n\n**PAGE 9**\npage 7\nend") == [(1, "a"), (5, "**PAGE 9**"), (7, "end")]


def test_no_marker_no_pages(spark):
    assert pages_of(spark, "just text") == []
    assert pages_of(spark, "") == []


def test_carriage_returns(spark):
    assert pages_of(spark, "PAGE 1\r\na\r\nPAGE 2\rb") == [(1, "a"), (2, "b")]


def test_divider(spark):
    texts = ["# Title\nshort page", "| a |\n", "word " * 15, "", "  # Indented\n" + "w " * 14]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(parse.is_divider(F.col("text")).alias("d"))
    assert [r["d"] for r in df.collect()] == [True, False, False, True, True]


def test_continuation_flag_after_suffix(spark):
    texts = ["Title (Cont..)", "Cont.....", "Continue..", "cont..."]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, i int")
    rows = parse.clean_continuations(df).orderBy("i").collect()
    assert [r["has_cont"] for r in rows] == [False, True, True, False]
    assert [r["text"] for r in rows] == ["Title", "", "", "cont..."]


def sections(spark, pages):
    df = spark.createDataFrame([("d", i, n, t) for i, (n, t) in enumerate(pages)], "doc_id string, page_ord int, page_num int, text string")
    return parse.heading_sections(df)


def test_heading_stack(spark):
    rows = sections(spark, [(1, "# A\nx\n## B\ny\n#### D\nz"), (2, "## C\nw\n# E\n\n# F\nq")]).orderBy("section").collect()
    assert [r["heading_path"] for r in rows] == [["A"], ["A", "B"], ["A", "B", "D"], ["A", "C"], ["F"]]
    assert [r["content"] for r in rows] == ["x", "y", "z", "w", "q"]
    assert [r["pages"] for r in rows] == [[1], [1], [1], [2], [2]]


def test_content_before_any_heading_and_indented_heading(spark):
    rows = sections(spark, [(3, "free\n  # not a heading"), (4, "more\n# H\nb")]).orderBy("section").collect()
    assert [(r["heading_path"], r["content"], r["pages"]) for r in rows] == [([], "free\n  # not a heading\nmore", [3, 4]), (["H"], "b", [4])]


def test_merge_only_neighbours(spark):
    rows = parse.merge_sections(sections(spark, [(1, "# A\nx\n# B\ny\n# A\nz\n# A\nw")])).orderBy("section").collect()
    assert [(r["heading_path"], r["content"]) for r in rows] == [(["A"], "x"), (["B"], "y"), (["A"], "z\n\nw")]


def test_packing(spark):
    text = "\n\n".join(["aaaa", "bbb", "cccc", "d" * 12, "e"])
    row = spark.createDataFrame([(text,)], "t string").select(parse.pack_paragraphs(F.col("t"), 10).alias("p")).first()
    assert row["p"] == ["aaaa\n\nbbb", "cccc", "d" * 12, "e"]


def test_content_types(spark):
    texts = ["| a | b |\n| c | d |", "| fault |\n|---|\nwarranty", "| fault |\n|---|", "installing it", "plain", ""]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    got = [r["k"] for r in df.orderBy("i").select(parse.content_type(F.col("t")).alias("k")).collect()]
    assert got == ["spec_table", "warranty", "error_code_table", "installation_sop", "text", "text"]


def test_flowchart(spark):
    texts = ["Flowchart", "Yes and no: check it", "yes no", "Yes No -> x"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").orderBy("i")
    assert [r["k"] for r in df.select(parse.is_flowchart(F.col("t")).alias("k")).collect()] == [True, True, False, True]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_models_and_codes(spark):
    series = ["DELTA ONE", "DELTA ONE PRIME"]
    assert one(spark, "Delta One Prime PRGD-200", lambda c: extract.model_names(c, series)) == ["DELTA ONE", "DELTA ONE PRIME", "PRGD-200"]
    assert one(spark, "EL 0 and E1, e2, 5E", extract.error_codes) == ["5E", "E1", "EL0"]


def test_table_codes(spark):
    good = "| Error Code | Note |\n|---|---|\n| E1<br>F 2 | 77 |\n| H12 |"
    assert sorted(one(spark, good, extract.table_codes)) == ["E1", "F2", "H12"]
    assert one(spark, good.replace("Error Code", "Inverter Error Code"), extract.table_codes) == []
    assert one(spark, "| Error Code |", extract.table_codes) == []


def test_pipeline_reports(spark):
    raw = "## PAGE 1\n# A\n" + "word " * 20 + "\n## PAGE 2\nshort\n## PAGE 3\n# B\nCont.....\n" + "text " * 30
    df = spark.createDataFrame([("d", raw), ("e", "nothing")], "doc_id string, raw string")
    rep = {r["doc_id"]: r for r in parse.ingest_report(df).collect()}
    assert rep["d"]["total_pages_parsed"] == 3 and rep["d"]["divider_pages_removed"] == [2] and rep["d"]["continuation_marker_pages"] == [3]
    assert rep["d"]["total_chunks"] == 2 and rep["e"]["total_pages_parsed"] is None
    ids = sorted(r["chunk_id"] for r in parse.parse_manuals(df, prefix="x_").collect())
    assert ids == ["x_d_0001", "x_d_0002"]
