from __future__ import annotations

import importlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone import repl
from lodestone.operators import index, layout
from lodestone.operators.parse import parse_manuals
from lodestone.plans import pipeline
from lodestone import scale
from lodestone.scale import cut_lineage, in_blocks, over_blocks, query_tables, running_totals, shared_folder, spread
from lodestone.settings import Settings
from lodestone.sources import tables
from lodestone.streaming.ingest import ingest, stream_manuals

RAW = "## PAGE 1\n# A\n" + "word " * 20 + "E1\n"


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "man 1.md").write_bytes(RAW.replace("\n", "\r\n").encode())
    df = tables.read_manuals(spark, str(tmp_path / "in"))
    assert [tuple(r) for r in df.collect()] == [("man 1", RAW)]
    chunks = parse_manuals(df).select("chunk_id", "text", "metadata")
    tables.write_chunks(chunks, str(tmp_path / "chunks"))
    back = tables.read_chunks(spark, str(tmp_path / "chunks"))
    assert back.collect() == chunks.collect() and back.first()["metadata"]["error_codes"] == ["E1"]
    parts = pipeline.build_indexes(back)
    tables.write_index({k: v for k, v in parts.items() if k != "chunks"}, str(tmp_path / "index"))
    assert tables.read_index(spark, str(tmp_path / "index"), "terms").count() == parts["terms"].count()
    with pytest.raises(FileNotFoundError):
        tables.read_index(spark, str(tmp_path / "index"), "nope")


def test_stream_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(RAW)
    args = (str(tmp_path / "out"), str(tmp_path / "state"))
    ingest(stream_manuals(spark, str(tmp_path / "in")), *args).awaitTermination()
    (tmp_path / "in" / "b.md").write_text(RAW)
    ingest(stream_manuals(spark, str(tmp_path / "in")), *args).awaitTermination()
    ingest(stream_manuals(spark, str(tmp_path / "in")), *args).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["chunk_id"] for r in rows) == ["a_0001", "b_0001"]


def test_documents_are_merged_by_bucket(spark, tmp_path):
    path = str(tmp_path / "docs")
    first = spark.createDataFrame([(f"d{i}", 1) for i in range(40)], "doc_id string, v int")
    tables.merge_documents(first, path)
    for _ in range(2):  # run again it writes the same
        tables.merge_documents(spark.createDataFrame([("d3", 2), ("d3", 3), ("new", 4)], "doc_id string, v int"), path)
    got = sorted((r["doc_id"], r["v"]) for r in tables.read_documents(spark, path).collect())
    assert got == sorted([(f"d{i}", 1) for i in range(40) if i != 3] + [("d3", 2), ("d3", 3), ("new", 4)])
    assert [r["v"] for r in tables.read_documents(spark, path, "new").collect()] == [4]
    tables.write_documents(first, path)
    assert tables.read_documents(spark, path).count() == 40 and tables.read_documents(spark, path, "d7").count() == 1


def test_other_sinks_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ü" if i % 2 else None) for i in range(5)], "n int, t string")
    tables.write_arrays(rows, str(tmp_path / "arrays"), ["n"], part_size=2)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "arrays")).collect()]
    assert sorted(lines) == ['[{"n":0},{"n":1,"t":"ü"}]', '[{"n":2},{"n":3,"t":"ü"}]', '[{"n":4}]']
    index_rows = spark.createDataFrame([("error_codes", "E1", "b"), ("error_codes", "E1", "a"), ("model_names", "X", "a")], "kind string, key string, chunk_id string")
    tables.write_exact_map(index_rows, str(tmp_path / "map"))
    assert sorted(map(tuple, tables.read_exact_map(spark, str(tmp_path / "map")).collect())) == sorted(map(tuple, index_rows.collect()))
    (tmp_path / "pdf").mkdir()
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / "pdf" / name).write_bytes(b"x")
    assert tables.first_pdf(spark, str(tmp_path / "pdf")).first()["path"].endswith("a.pdf") and tables.read_pdf_names(spark, str(tmp_path / "pdf")).count() == 2
    (tmp_path / "rules.json").write_text('{"place": 2, "pattern": "b", "replacement": "c"}\n{"place": 1, "pattern": "a", "replacement": "b"}\n')
    rules = tables.read_rules(spark, str(tmp_path / "rules.json"))
    assert rules == (("a", "b"), ("b", "c")) and spark.sql("SELECT 'a  x' AS t").select(layout.clean_ocr(F.col("t"), rules)).first()[0] == "c x"
    (tmp_path / "cat.json").write_text('{"place": 2, "category": "lamp", "needle": "Bulb"}\n{"place": 1, "category": "pump", "needle": "valve"}\n')
    assert tables.read_categories(spark, str(tmp_path / "cat.json")) == (("pump", ("valve",)), ("lamp", ("bulb",)))
    with pytest.raises(ValueError, match="more than"):
        tables.read_rules(spark, str(tmp_path / "rules.json"), most=1)
    tables.append_cache(rows, str(tmp_path / "cache"))
    tables.append_cache(rows, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 10 and tables.healthy(spark).first()["ok"] == 1
    tables.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 5


def test_settings_and_loop(spark):
    spark.conf.set("spark.lodestone.index", "held")
    told = Settings.read(spark, {"LODESTONE_INDEX": "other", "LODESTONE_ANSWER_MODELS": "a, b,", "LODESTONE_CHUNKS": " "})
    assert (told.index, told.chunks, told.models("answer_models"), told.models("language_models")) == ("held", "phase1_chunks", ["a", "b"], [])
    said = []
    assert repl.loop(["", "  what ", "EXIT", "more"], lambda q: (q + "?", ["s"]), said.append) == 1 and said == ["what?", "  - s"]


def test_answer_batch(spark):
    meta = "struct<title:string,page_start:int,page_end:int,source_pages:array<int>,product_category:string,section:string,content_type:string,model_names:array<string>,error_codes:array<string>,char_count:int>"
    rows = [(f"c{i}", f"pump {i} shows E{i}", ("T", 1, 1, [1], "general", "s", "text", [], [f"E{i}"], 9)) for i in range(8)]
    parts = pipeline.build_indexes(spark.createDataFrame(rows, f"chunk_id string, text string, metadata {meta}"))
    q = spark.createDataFrame([("q1", "what is E3", "en"), ("q2", "zzz", None)], "qid string, text string, language string")
    got = {r["qid"]: r for r in pipeline.answer_batch(q, parts).collect()}
    assert got["q1"]["context"].startswith("--- CHUNK [c3]") and got["q2"]["context"] == "" and got["q2"]["language"] == "Unknown"


def test_answer_batch_takes_vector_hits_and_the_understanding(spark, tmp_path):
    meta = "struct<title:string,page_start:int,page_end:int,source_pages:array<int>,product_category:string,section:string,content_type:string,model_names:array<string>,error_codes:array<string>,char_count:int>"
    rows = [(f"c{i}", f"pump {i} shows E{i}", ("T", 1, 1, [1], "general", "s", "text", [], [f"E{i}"], 9)) for i in range(8)]
    spark.createDataFrame(rows, f"chunk_id string, text string, metadata {meta}").write.parquet(str(tmp_path / "phase1_chunks.parquet"))
    q = [("q1", "zzz", "en", "usage"), ("q2", "kya masla E3 hai", "ur", None), ("q3", "zzz", "en", None)]
    spark.createDataFrame(q, "qid string, text string, language string, intent string").write.parquet(str(tmp_path / "questions.parquet"))
    hits = [("q1", "Vector", 9, "c5", 0.7), ("q1", "vector", 1, "c6", float("nan")), ("q3", "rerank", 1, "c5", 0.7)]
    spark.createDataFrame(hits, "qid string, source string, rank int, chunk_id string, score double").write.parquet(str(tmp_path / "retrieved_chunks.parquet"))
    got = {r["qid"]: r for r in importlib.import_module("__spark_entry__").queries()["answer_batch"](spark, str(tmp_path)).collect()}
    assert got["q1"]["context_chars"] > 0 and got["q3"]["context_chars"] == 0 and got["q1"]["intent"] == "usage"
    assert got["q2"]["language"] == "Roman Urdu" and got["q2"]["is_roman_urdu"] and got["q2"]["error_codes"] == "E3" and got["q2"]["context_chars"] > 0


def test_understood_questions_are_searched_in_translation(spark):
    q = spark.createDataFrame([("q1", "zzz", "pump shows E3")], "qid string, text string, translated_query string")
    meta = "struct<title:string,page_start:int,page_end:int,source_pages:array<int>,product_category:string,section:string,content_type:string,model_names:array<string>,error_codes:array<string>,char_count:int>"
    rows = [(f"c{i}", f"pump {i} shows E{i}", ("T", 1, 1, [1], "general", "s", "text", [], [], 9)) for i in range(4)] + [("d", "tap", ("T", 1, 1, [1], "general", "s", "text", [], [], 9))] * 4
    parts = pipeline.build_indexes(spark.createDataFrame(rows, f"chunk_id string, text string, metadata {meta}"))
    r = pipeline.answer_batch(q, parts).first()
    assert r["context"].startswith("--- CHUNK [c3]") and "zzz" in r["prompt"] and "pump shows E3" in r["prompt"]


def test_series_names_beyond_a_thousand_are_read(spark, tmp_path):
    names = [f"S{i:04d}" for i in range(1010)]
    spark.createDataFrame([(x,) for x in [*names, None]], "series string").write.parquet(str(tmp_path / "product_models.parquet"))
    assert importlib.import_module("lodestone.plans.registry").series(spark, str(tmp_path)) == names


def test_running_totals_match_a_loop_whatever_the_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    want, sums = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        want[o] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r["o"]: r["t"] for r in running_totals(df, ["k"], [F.col("o").asc()], {"t": F.col("v")}).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cut_lineage_and_spread(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.array(F.col("id"))))
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert spread(df.groupBy("id").count()).rdd.getNumPartitions() == 8
    assert cut_lineage(df.filter("false")).count() == 0


def test_spread_asks_the_plan_not_its_text(spark):
    one = spark.range(10).coalesce(1).select(F.col("id").alias("a Join of Sort"))
    assert spread(one).rdd.getNumPartitions() == 8 and spread(spark.range(0, 100, 1, 20).withColumnRenamed("id", "Window")).rdd.getNumPartitions() == 20


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):  # noqa: N802
            return None

        def setCheckpointDir(self, folder):  # noqa: N802
            self.folder = folder

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: None)})

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            shared_folder(Session(master))
    assert shared_folder(Session("local[4]")) and shared_folder(Session("local"))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_query_tables_are_removed_at_the_end_of_the_block(spark):
    kept = cut_lineage(spark.range(3))
    with query_tables():
        inner = cut_lineage(spark.range(4))
        assert inner.count() == 4 and len(scale._written) > 0
        gone = scale._written[-1][1]
    assert kept.count() == 3 and gone not in [p for _, p in scale._written]
    with pytest.raises(Exception, match="not exist|NOT_EXIST|FAILED_READ"):
        inner.collect()


def test_blocks_are_bounded_and_fetched_one_by_one(spark):
    assert list(in_blocks(range(7), 3, 100, lambda x: 1)) == [[0, 1, 2], [3, 4, 5], [6]]
    assert list(in_blocks([5, 9, 1, 1], 10, 6, lambda x: x)) == [[5], [9], [1, 1]] and list(in_blocks([], 3, 3, len)) == []
    fetched = []

    def rows():
        for i in range(5):
            fetched.append(i)
            yield i

    seen = []

    def run(shared):
        seen.append((list(shared.value), len(fetched)))
        return spark.createDataFrame([(x,) for x in shared.value], "x int")

    assert sorted(r["x"] for r in over_blocks(spark, in_blocks(rows(), 1, 9, lambda x: 1), run).collect()) == [0, 1, 2, 3, 4]
    assert seen[0] == ([0], 3) and over_blocks(spark, iter([]), run) is None


def test_vector_index_is_built_stored_and_searched(spark, tmp_path):
    meta = "struct<title:string,page_start:int,page_end:int,source_pages:array<int>,product_category:string,section:string,content_type:string,model_names:array<string>,error_codes:array<string>,char_count:int>"
    rows = [(f"c{i:02}", "x" * i, ("T", 1, 1, [1], "general", "s", "text", [], [], 9)) for i in range(40)]

    def embedder(texts):
        n = F.length("text").cast("double")
        return texts.select("chunk_id", F.array(F.cos(n / 20), F.sin(n / 20), F.lit(0.0)).alias("embedding"))

    parts = pipeline.build_indexes(spark.createDataFrame(rows, f"chunk_id string, text string, metadata {meta}"), embedder)
    tables.write_index({k: parts[k] for k in ("vectors", "centres")}, str(tmp_path))
    stored = {k: tables.read_index(spark, str(tmp_path), k) for k in ("vectors", "centres")}
    assert stored["vectors"].count() == 40 and "cell" in stored["vectors"].columns
    asked = index.unit_vectors(embedder(spark.createDataFrame([("c07", "Section: T\n" + "x" * 7)], "chunk_id string, text string")), "chunk_id", "embedding")
    best = pipeline.search_vectors(asked.select(F.col("chunk_id").alias("qid"), "unit"), stored, top=3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == ["c07", "c06", "c08"]


def test_registry_and_sql_agree_on_names():
    entry = importlib.import_module("__spark_entry__")
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


def test_running_totals_of_whole_groups(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 4), (None, 1, 5)], "k string, o int, v int")
    got = {(r["k"], r["o"]): (r["t"], r["t_all"]) for r in running_totals(df, ["k"], [F.col("o").asc()], {"t": F.col("v")}, whole=True).collect()}
    assert got == {("a", 1): (0, 5), ("a", 2): (2, 5), ("b", 1): (0, 4), (None, 1): (0, 5)}


def test_without_divides_a_hot_key(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 60 else f"k{i}" if i < 90 else None) for i in range(100)], "id int, k string")
    gone = spark.createDataFrame([("hot",), ("hot",), ("k70",), (None,)], "k string")
    left = scale.without(rows, gone, "k", "id")
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(60, 100) if i != 70] and left.columns == ["id", "k"]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_distinct_messages_do_not_hang_on_the_order(spark):
    from lodestone.operators import chat

    rows = [("m", "c", "user", "b"), ("m", "c", "user", "a"), ("n", "c", None, None), (None, "c", "user", "x")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "id string, conversation_id string, role string, text string").withColumn("created_at", F.lit(None).cast("timestamp"))
        assert sorted((r["id"], r["text"]) for r in chat.distinct_messages(df).collect()) == [("m", "a"), ("n", None)]
