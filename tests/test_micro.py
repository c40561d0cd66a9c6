"""Hand-made cases of cleaning, and the two forms against each other."""

import pytest
from pyspark.sql import functions as F

from mdloom.functions import text as X
from mdloom.operators import exploded as E
from mdloom.operators import narrow as N

NINE = "|---|---|---|---|---|---|---|---|---|"
CASES = [
    ("a\r\nb\rc", "a\nb\nc"),
    ("a  \n\n\n\n\nb", "a\n\n\nb"),
    ("a\n \n\t\n \nb", "a\n\n\nb"),
    ("| a | b |\n| 1 | 2 |", None),
    ("| a | b |\n|---|---|\n| 1 | 2 |", None),
    ("| a |  | b |\n|---|:-:|---|\n| 1 |  | 22222 |", "| a   | b     |\n|-----|-------|\n| 1   | 22222 |"),
    ("| a | b |\n|---|---|\n| 1 |  |", None),
    ("| a |  | b |\n|---|---|---|\n|  |  |  |\n| 1 |  | 2 |", "| a   | b   |\n|-----|-----|\n|-----|-----|\n| 1   | 2   |"),
    ("| a |  |\n|  |  |", "| a   |\n|-----|"),
    ("| a | ** |\n|---|---|\n| 1 | ** |", "| a   |\n|-----|\n| 1   |"),
    ("x\n||\n|---|\ny", "x\n\ny"),
    ("|---|", None),
    ("```\n| a |  |\n|---|---|\n| 1 |  |\n```", "```\n| a   |\n|-----|\n| 1   |\n```"),
    (" | a | b |\n |---|---|", None),
    ("| a | b |\n|---|---", None),
    ("a 　\nb", "a\nb"),
    (" | a |  |\n|---|---|", "| a   |\n|-----|"),
    (f"| A |  |  |  |  |  |  |  |  |\n{NINE}\n|  | **B** |  |  |  |  |  |  |  |\n| 1 | 2 | 3 |  |  |  |  |  |  |", "**A:** 1\n**B:** 2\n  - 3"),
    ("| h1 | h2 | h3 | h4 | h5 | h6 | h7 | h8 | h9 |\n" + NINE + "\n| 1 |  |\n| 2 |", "**h1:** 1\n\n---\n\n**h1:** 2"),
    (f"| H |  |  |  |  |  |  |  |  |\n{NINE}\n| x  - y  1. z  w |", "**H:**\n  - x\n  - y\n  1. z\n  - w"),
    (f"|  | H |  |  |  |  |  |  |  |\n{NINE}\n| - x |", "  - - x"),
    (f"| H |  |  |  |  |  |  |  |  |\n{NINE}\n" + "| **b** " * 9 + "|", None),
    (f"| H |  |  |  |  |  |  |  |  |\n{NINE}\n" + "\n".join("| **b** " * 9 + "|" for _ in range(4)), "**H:** **b**\n" + "\n".join(["**b:** **b**"] * 8)),
    (f"| H |  |  |  |  |  |  |  |  |\n{NINE}\n| **s** |\n|  |  |\n| **t** |\n| 1 |", "**H:** 1"),
    (f"| H |  |  |  |  |  |  |  |  |\n{NINE}\n| a  b |", "**H:** a  b"),
    ("| a | b |\n|---|---|\n| 1 | " + "x" * 200 + " |", None),
    ("| a | b |\n|---|---|\n| 1 | " + "x" * 201 + " |", "**a:** 1\n**b:** " + "x" * 201),
    ("", None),
]


def test_clean_markdown(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "doc_id long, content string")
    got = {r.doc_id: r.c for r in df.select("doc_id", N.clean_markdown("content").alias("c")).collect()}
    assert [got[i] for i in range(len(CASES))] == [x if y is None else y for x, y in CASES]
    again = df.sparkSession.createDataFrame(list(got.items()), "doc_id long, content string").select("doc_id", N.clean_markdown("content").alias("c"))
    assert {r.doc_id: r.c for r in again.collect()} == got


def test_both_forms_agree(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "doc_id long, content string")
    narrow = {r.doc_id: r.c for r in df.select("doc_id", N.clean_tables(X.normalize_endings("content")).alias("c")).collect()}
    assert {r.doc_id: r.content for r in E.clean_tables_exploded(df.repartition(5)).collect()} == narrow


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, content string")
    assert {r.doc_id: r.c for r in df.select("doc_id", N.clean_markdown("content").alias("c")).collect()} == {1: None, 2: ""}
    assert E.clean_tables_exploded(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("line", "cells"),
    [("| a | b |", ["a", "b"]), ("| a | b", ["a", "b"]), ("| a |  |  |", ["a", "", ""]), ("| a \\| b |", ["a \\", "b"]), ("||", [""]), ("|", [])],
)
def test_split_cells(spark, line, cells):
    assert spark.range(1).select(X.split_cells(F.lit(line))).first()[0] == cells


def test_names(spark):
    rows = spark.createDataFrame([(x,) for x in ("a.pdf", "d/a.tar.gz", "a", ".md", "d.x/a")], "n string")
    got = [tuple(r) for r in rows.select(X.extension("n"), X.output_name("n"), X.ensure_suffix("n")).collect()]
    assert got == [(".pdf", "a.md", "a.pdf.md"), (".gz", "d/a.tar.md", "d/a.tar.gz.md"), ("", "a", "a.md"), ("", ".md", ".md"), ("", "d.x/a", "d.x/a.md")]


def test_converters_fail_alone(spark):
    from mdloom.sources.files import convert_documents

    files = spark.createDataFrame([("p/a.pdf", "a.pdf", ".pdf", 1, b"x"), ("p/b.pdf", "b.pdf", ".pdf", 1, b""), ("p/c.doc", "c.doc", ".doc", 1, b"x")], "path string, original_filename string, ext string, length long, content binary")

    def convert(content):
        if not content:
            raise ValueError("empty file")
        return "ok  \n"

    got = {r.original_filename: (r.status, r.error, r.markdown) for r in convert_documents(files, {".pdf": convert}).collect()}
    assert got == {"a.pdf": ("done", None, "ok\n"), "b.pdf": ("failed", "empty file", None), "c.doc": ("failed", "no converter for .doc", None)}


def test_lists_are_made_once(spark):
    """A filter on lists isn't pushed down to where it would make them, and what they are made of, again."""
    docs = spark.createDataFrame([(1, "| a |\n|---|\n| 1 |"), (2, "| a |\n|---|")], "doc_id long, content string")
    lists = E.structured_lists(E.md_tables(docs))
    assert [(r.doc_id, r.structured) for r in lists.collect()] == [(1, "**a:** 1")]
    assert lists._jdf.queryExecution().optimizedPlan().toString().count("\n\n---\n\n") == 1
