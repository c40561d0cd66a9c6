"""Files, conversion, look-ups and streams, on hand-made cases."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from mdloom import session
from mdloom.operators import exploded as E
from mdloom.operators import narrow as N
from mdloom.plans.reports import reports
from mdloom.session import shared_folder
from mdloom.sources import files as S
from mdloom.streaming import streams as Z

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    files = {"good.html": b"<p>caf\xc3\xa9</p>", "bad.HTML": b"<p>caf\xe9</p>", "a.docx": b"d\xff", "b.pdf": b"boom", "c.png": b"x", ".pdf": b"x", "n.MD": b"# n", "x.txt": b"t"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.PPTX").write_bytes(b"p")
    return f"file://{tmp_path}"


def test_only_wanted_files_are_opened(spark, folder):
    assert {r.original_filename: r.ext for r in S.scan_documents(spark, folder).collect()} == {"good.html": ".html", "bad.HTML": ".html", "a.docx": ".docx", "b.pdf": ".pdf", "deep.PPTX": ".pptx"}
    assert {r.file_name for r in S.scan_markdown(spark, folder).collect()} == {"n.MD", "x.txt"}


def test_a_bad_file_fails_alone(spark, folder):
    def pdf(data: bytes) -> str:
        raise RuntimeError(data.decode())

    for converters, errors in (
        (None, {"a.docx": "no converter for .docx", "b.pdf": "no converter for .pdf", "deep.PPTX": "no converter for .pptx", "bad.HTML": "not UTF-8", "good.html": None}),
        ({".docx": lambda data: f"{len(data)} bytes\r\n", ".pdf": pdf}, {"a.docx": None, "b.pdf": "boom", "deep.PPTX": "no converter for .pptx", "bad.HTML": "not UTF-8", "good.html": None}),
    ):
        ledger = S.convert_documents(S.scan_documents(spark, folder), converters)
        got = {r.original_filename: r for r in ledger.collect()}
        assert {k: r.error for k, r in got.items()} == errors
        assert all((r.status == "failed") == (r.error is not None) == (r.markdown is None) for r in got.values())
        assert got["good.html"].markdown == "café"
        assert {r.original_filename for r in S.failed_jobs(ledger).collect()} == {k for k, e in errors.items() if e}
    assert got["a.docx"].markdown == "2 bytes\n"


def test_a_converter_that_hangs_fails_alone(spark, folder):
    def slow(data: bytes) -> str:
        import time

        while data == b"boom":
            time.sleep(0.05)
        return "done"

    ledger = S.convert_documents(S.scan_documents(spark, folder), {".pdf": slow, ".docx": slow}, seconds=1)
    got = {r.original_filename: (r.error, r.markdown) for r in ledger.collect()}
    assert got["b.pdf"] == ("no result within 1 s", None) and got["a.docx"] == (None, "done") and got["good.html"] == (None, "café")


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_stored_results_push_the_filter(spark, folder, tmp_path):
    stored = S.write_ledger(S.convert_documents(S.scan_documents(spark, folder)), f"file://{tmp_path}/ledger")
    job = stored.where("original_filename = 'good.html'").first()
    one = S.stored_results(stored, [job.job_id, "none"])
    assert [(r.success, r.job_id, r.original_filename, r.markdown) for r in one.collect()] == [(True, job.job_id, "good.html", job.markdown)]
    assert re.search(r"PushedFilters: \[.*In\(job_id", plan_of(one)) and "Join" not in plan_of(one)


def test_lost_content_finds_what_was_damaged(spark):
    docs = reports(spark, DATA)
    clean = docs.select("doc_id", N.clean_markdown("content").alias("content"))
    assert E.lost_content(docs, clean).count() == 0
    word = E.md_cells(E.md_rows(E.md_lines(docs))).where("data_row_no > 4 and cell rlike '^[A-Za-z0-9.-]{5,}$'").orderBy("doc_id", "table_no", "row_no", "col_no").select("doc_id", "cell").first()
    damaged = clean.withColumn("content", F.when(F.col("doc_id") == word.doc_id, F.replace("content", F.lit(word.cell), F.lit("?"))).otherwise(F.col("content")))
    assert (word.doc_id, word.cell) in {(r.doc_id, r.word) for r in E.lost_content(docs, damaged).collect()}


def test_exploded_form_shuffles_lines_once(spark, tmp_path):
    reports(spark, DATA).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    rows = E.md_rows(E.md_lines(docs))
    for df, most in ((E.table_stats(rows), 1), (E.md_fields(rows), 1), (E.structured_lists(rows), 1), (E.rebuild_tables(rows), 1), (E.clean_tables_exploded(docs), 3)):
        assert len(re.findall(r"- Exchange \(", plan_of(df).split("\n\n\n")[0])) <= most


def test_table_facts_take_no_shuffle_and_equal_the_exploded_form(spark, tmp_path):
    odd = [(1, None), (2, ""), (3, "|"), (4, "| a |\r\n|-|\r\n| b |\r\nx\n  | c | ** |\n|  |  |\n|--|"), (5, "no pipe"), (6, "x | y"), (7, "| a |\n" * 3 + "\n| b |")]
    spark.createDataFrame(odd, "doc_id long, content string").unionByName(reports(spark, DATA).selectExpr("doc_id + 100 as doc_id", "content")).write.parquet(f"{tmp_path}/facts")
    docs = spark.read.parquet(f"{tmp_path}/facts")
    narrow = N.table_stats(docs)
    exploded = E.table_stats(E.md_rows(E.md_lines(docs.where("content is not null"))))
    assert narrow.columns == exploded.columns and narrow.dtypes == exploded.dtypes
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, exploded.collect()))
    assert "Exchange" not in plan_of(narrow) and "Sort" not in plan_of(narrow)


def batches(spark, tmp_path, parts, schema):
    """A stream that gets each part as a batch of its own."""
    source = f"{tmp_path}/in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/part{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)


def test_bursts_close_once_and_late_edits_are_dropped(spark, tmp_path):
    parts = [
        [("k", "2024-01-01 00:00:00", "a"), ("k", "2024-01-01 00:00:01", "b"), ("m", "2024-01-01 00:00:00", "x")],
        [("k", "2024-01-01 00:00:02", "c"), ("k", "2024-01-01 01:00:00", "d")],
        [("m", "2024-01-01 03:00:00", "y")],
        [("k", "2024-01-01 00:00:03", "too late"), ("m", "2024-01-01 09:00:00", "end")],
    ]
    edits = batches(spark, tmp_path, parts, "key string, at string, content string").selectExpr("key", "cast(at as timestamp) as ts", "content")
    out = Z.run_append(Z.debounced_latest(edits, "2 seconds", "10 minutes"), f"file://{tmp_path}/out")
    assert sorted((r.key, r.content) for r in out.collect()) == [("k", "c"), ("k", "d"), ("m", "x"), ("m", "y")]


def test_progress_in_update_mode(spark, tmp_path):
    parts = [[("a", 1, "uploading"), ("b", 1, "uploading")], [("a", 3, "generating")], [("a", 2, "extracting"), ("b", 5, "complete")]]
    stages = batches(spark, tmp_path, parts, "job string, ts long, stage string")
    out = Z.run_update(Z.job_progress(stages), f"file://{tmp_path}/out", ["job"])
    assert sorted((r.job, r.stage, r.ts) for r in out.collect()) == [("a", "generating", 3), ("b", "complete", 5)]
    assert spark.read.parquet(f"{tmp_path}/out/changed").count() == 5  # a in three batches, b in two

def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(Session, "x")


def test_tables_need_no_shuffle_or_sort_and_lines_from_elsewhere_give_the_same(spark, tmp_path):
    odd = [(1, ""), (2, "|"), (3, "| a |\r\n|-|\r\n| b |\r\nx\n  | c | ** |\n|  |  |\n|--|"), (4, "|-|\n|-|\n| a |\n|-|\n| **b** |\n| c  d |"), (5, "a\n" * 3), (6, "|-|\n|--|"), (7, "| a |\n" * 3 + "\n| b |")]
    spark.createDataFrame(odd, "doc_id long, content string").unionByName(reports(spark, DATA).selectExpr("doc_id + 100 as doc_id", "content")).write.parquet(f"{tmp_path}/odd")
    docs = spark.read.parquet(f"{tmp_path}/odd")
    tables, lines, rows = E.md_tables(docs), E.md_lines(docs).repartition(5), E.md_rows(E.md_lines(docs)).repartition(5)
    for f in (E.md_rows, E.md_cells, E.subheader_rows, E.empty_columns, E.drop_empty_columns, E.column_widths, E.header_names, E.table_records, E.md_fields, E.structured_lists, E.rebuild_tables, E.table_stats):
        out = f(tables)
        plan = plan_of(out)
        assert not re.search("Exchange|Sort|Window|Aggregate", plan), f.__name__
        want = sorted(map(str, out.collect()))
        assert want and want == sorted(map(str, f(lines if f is E.md_rows else rows).collect())), f.__name__
    lost = E.lost_words(docs.withColumn("after", F.expr("substring(content, 1, 40)")), "content", "after")
    assert not re.search("Exchange|Sort|Window|Aggregate", plan_of(lost))
    other = E.lost_content(docs, docs.selectExpr("doc_id", "substring(content, 1, 40) as content"))
    assert lost.count() and sorted(map(str, lost.collect())) == sorted(map(str, other.collect()))


def test_reports_of_larger_tables_are_made_in_more_tasks(spark, monkeypatch):
    few = sorted(reports(spark, DATA).collect())
    monkeypatch.setattr(session, "TASK_BYTES", 4096)
    df = reports(spark, DATA)
    assert df.rdd.getNumPartitions() > 8 and sorted(df.collect()) == few


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_reports_move_before_they_are_texts_however_many_shuffle_partitions_there_are(spark, monkeypatch, broadcast):
    few = sorted(reports(spark, DATA).collect())
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 16)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        df = reports(spark, DATA)
        assert "ENSURE_REQUIREMENTS" not in plan_of(df) and 8 < df.rdd.getNumPartitions() < 200
        assert sorted(df.collect()) == few
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lost_words_are_told_from_one_text_a_document(spark):
    wide = "| **h 1** | b |  |  |  |  |  |  | i |\n|---|---|---|---|---|---|---|---|---|\n| x:y |  |  |  |  |  |  |  | \u00a0- z-- |"
    rows = [(1, "a  b\n--\n| q |\t|\n|---|---|\n| c:d |\u00a0e\u00a0|", "a b q c e"), (2, wide, "h 1"), (3, None, None), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, content string, content_clean string")
    assert r"[\s*:|]+, -1)" not in plan_of(E.lost_words(docs))  # a split by a pattern, which would be compiled for each cell
    assert sorted(tuple(r) for r in E.lost_words(docs).collect()) == [(1, "d", 1), (2, "i", 1), (2, "x", 1), (2, "y", 1), (2, "z--", 1)]
