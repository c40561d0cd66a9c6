"""Incremental conversion, the stream of files, and the sink that commits."""

import io
import os
import re
import uuid
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from mdloom.sources import ledger as L
from mdloom.sources.files import document_files
from mdloom.sources.sink import RowFiles, export_files


@pytest.fixture
def place(tmp_path):
    for name in ("in", "calls"):
        (tmp_path / name).mkdir()
    return tmp_path


def counting(calls):
    """A converter that leaves a file for each call."""

    def convert(data: bytes) -> str:
        (calls / uuid.uuid4().hex).write_bytes(data)
        if data == b"bad":
            raise RuntimeError("cannot read")
        return f"text of {data.decode()}"

    return {".docx": convert}


def table(spark, ledger):
    return sorted((r.original_filename, r.status, r.error, r.markdown, r.run) for r in L.stored_jobs(spark, ledger).collect())


def test_only_what_changed_is_converted(spark, place):
    source, ledger, convert = f"file://{place}/in", f"file://{place}/ledger", counting(place / "calls")
    assert L.convert_new(spark, source, ledger, convert) == 0 and table(spark, ledger) == []
    for name, data in {"a.docx": b"a", "b.docx": b"b", "bad.docx": b"bad", "p.html": b"<p>x"}.items():
        (place / "in" / name).write_bytes(data)
    assert L.convert_new(spark, source, ledger, convert) == 1
    first = [("a.docx", "done", None, "text of a", 1), ("b.docx", "done", None, "text of b", 1), ("bad.docx", "failed", "cannot read", None, 1), ("p.html", "done", None, "x", 1)]
    assert table(spark, ledger) == first and len(os.listdir(place / "calls")) == 3
    assert L.convert_new(spark, source, ledger, convert) == 1 and len(os.listdir(place / "calls")) == 3
    (place / "in" / "a.docx").write_bytes(b"a two")
    (place / "in" / "sub").mkdir()
    (place / "in" / "sub" / "b.docx").write_bytes(b"b")  # known by name and content
    (place / "in" / "c.docx").write_bytes(b"c")
    (place / "in" / "sub" / "c.docx").write_bytes(b"c")  # one job with the other
    assert L.convert_new(spark, source, ledger, convert) == 2
    assert table(spark, ledger) == sorted([*first, ("a.docx", "done", None, "text of a two", 2), ("c.docx", "done", None, "text of c", 2)])
    assert {p.read_bytes() for p in (place / "calls").iterdir()} == {b"a", b"b", b"bad", b"a two", b"c"} and len(os.listdir(place / "calls")) <= 6
    now = {os.path.relpath(r.source_path.removeprefix("file:"), place / "in"): r.markdown for r in L.current_jobs(spark, ledger).collect()}
    assert now == {"a.docx": "text of a two", "b.docx": "text of b", "sub/b.docx": "text of b", "bad.docx": None, "p.html": "x", "c.docx": "text of c", "sub/c.docx": "text of c"}


def test_a_run_lists_its_folder_once_and_holds_contents_against_late_files_only(spark, place, monkeypatch):
    source, ledger, calls, met = f"file://{place}/in", f"file://{place}/ledger", [], []
    monkeypatch.setattr(L, "document_files", lambda *a, **k: calls.append(a) or document_files(*a, **k))
    take_in = L.take_in
    monkeypatch.setattr(L, "take_in", lambda files, *a: met.append(files._jdf.queryExecution().optimizedPlan().toString()) or take_in(files, *a))

    def put(name, at):
        (place / "in" / name).write_bytes(f"<p>{name}".encode())
        os.utime(place / "in" / name, (at, at))

    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    for run, files in enumerate(([("a.html", 1000), ("b.html", 2000)], [("c.html", 3000), ("d.html", 3000)], [("e.html", 3000), ("f.html", 1500), ("a.html", 1000.5)]), 1):
        for name, at in files:
            put(name, at)
        assert L.convert_new(spark, source, ledger) == run and len(calls) == run
        assert ("Join" in met[-1]) == (run == 3)  # only then are known files as late as new ones
    assert L.convert_new(spark, source, ledger) == 3 and len(calls) == 4 and len(met) == 3
    seen = sorted((os.path.basename(r.source_path), r.run) for r in L.seen_files(spark, ledger).collect())
    assert seen == [("a.html", 1), ("a.html", 3), ("b.html", 1), ("c.html", 2), ("d.html", 2), ("e.html", 3), ("f.html", 3)]
    assert [(r[0], r[4]) for r in table(spark, ledger)] == [("a.html", 1), ("b.html", 1), ("c.html", 2), ("d.html", 2), ("e.html", 3), ("f.html", 3)]
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost
    empty = L.stored_jobs(spark, f"file://{place}/none")
    assert "LocalRelation <empty>" in empty._jdf.queryExecution().optimizedPlan().toString() and empty.columns[-1] == "run"


def test_a_run_that_is_done_again_replaces_itself(spark, place):
    source, ledger = f"file://{place}/in", f"file://{place}/ledger"
    (place / "in" / "p.html").write_bytes(b"<p>x")
    for _ in range(2):
        L.take_in(document_files(spark, source), ledger, 1)
        assert table(spark, ledger) == [("p.html", "done", None, "x", 1)]
    assert L.seen_files(spark, ledger).count() == 1


def test_old_contents_stay_unread(spark, place):
    files = document_files(spark, f"file://{place}/in").where(F.col("modified") >= F.lit("2030-01-01").cast("timestamp"))
    out = io.StringIO()
    with redirect_stdout(out):
        files.explain("formatted")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(modificationTime", out.getvalue())
    out = io.StringIO()
    with redirect_stdout(out):
        document_files(spark, f"file://{place}/in").select("path", "modified", "length").explain("formatted")
    assert "content" not in re.search(r"ReadSchema: .*", out.getvalue())[0]


def test_stream_takes_each_file_once(spark, place):
    source, ledger, convert = f"file://{place}/in", f"file://{place}/ledger", counting(place / "calls")
    for name in ("a.docx", "bad.docx", "c.docx"):
        (place / "in" / name).write_bytes(name[:-5].encode())
    L.stream_new(spark, source, ledger, convert, per_batch=1).start().awaitTermination()
    (place / "in" / "p.html").write_bytes(b"<p>x")
    (place / "in" / "sub").mkdir()
    (place / "in" / "sub" / "a.docx").write_bytes(b"a")  # the job of another batch
    L.stream_new(spark, source, ledger, convert, per_batch=1).start().awaitTermination()
    rows = table(spark, ledger)
    assert [r[:4] for r in rows] == [("a.docx", "done", None, "text of a"), ("bad.docx", "failed", "cannot read", None), ("c.docx", "done", None, "text of c"), ("p.html", "done", None, "x")]
    assert len({r[4] for r in rows}) == 4 and len(os.listdir(place / "calls")) == 3
    whole = f"file://{place}/whole"
    L.convert_new(spark, source, whole, convert)
    assert [r[:4] for r in table(spark, whole)] == [r[:4] for r in rows]


def listing(folder):
    return {p.name: p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_a_failed_export_leaves_nothing(spark, place):
    folder = place / "out"
    export_files(spark.range(20).selectExpr("concat('f', id) as name", "concat('text ', id) as content").repartition(4), f"file://{folder}", "name", "content")
    before = listing(folder)
    assert before == {f"f{i}": f"text {i}".encode() for i in range(20)} and not [p for p in folder.iterdir() if p.is_dir()]
    broken = spark.range(20).selectExpr("if(id = 13, 'a/b', concat('g', id)) as name", "'new' as content").repartition(4)
    with pytest.raises(Exception, match="not a file name"):
        export_files(broken, f"file://{folder}", "name", "content")
    assert listing(folder) == before and not [p for p in folder.iterdir() if p.is_dir()]
    export_files(spark.createDataFrame([("f1", b"\xff"), ("empty", None)], "name string, content binary"), f"file://{folder}", "name", "content")
    assert listing(folder) == before | {"f1": b"\xff", "empty": b""}


def test_only_committed_attempts_are_moved(spark, place):
    """An attempt that wrote all of its files but isn't in the commit (a copy that lost the race) leaves none."""
    import pyarrow as pa

    writer = RowFiles({"path": f"file://{place}/out"}).writer(spark.range(0).selectExpr("'' as a", "'' as b").schema, False)
    batch = pa.RecordBatch.from_pydict({"name": ["x"], "content": ["one"]})
    kept, lost = writer.write(iter([batch])), writer.write(iter([pa.RecordBatch.from_pydict({"name": ["x", "y"], "content": ["two", "two"]})]))
    assert kept.n == 1 and lost.n == 2
    writer.commit([kept, None])
    assert listing(place / "out") == {"x": b"one"}
