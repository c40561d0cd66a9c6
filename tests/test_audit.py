"""What cleaning did, and that it lost nothing: losses by count, line changes, the audit beside the text, look-ups by Bloom filter."""

import difflib
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from mdloom.operators import exploded as E
from mdloom.operators import narrow as N
from mdloom.plans.reports import reports
from mdloom.sources import files as S

DATA = "/root/testdata/sf0.001"


def test_one_lost_copy_of_a_word_is_found(spark):
    wide = "| a | b | c | d | e | f | g | h | i |\n|-|-|-|-|-|-|-|-|-|\n| x | x | y |\n| x | a |"
    raw = spark.createDataFrame([(1, f"word word\n{wide}\nend"), (2, "| p | |\n|-|-|\n| q q | |"), (3, "| no | rule |")], "doc_id long, content string")
    clean = raw.select("doc_id", N.clean_markdown("content").alias("content"))
    assert E.lost_content(raw, clean).collect() == []
    for text, word, n in (("word", "word", 1), ("**b:** x", "x", 1), ("q", "q", 1), ("no", "no", 1)):
        once = clean.withColumn("content", F.expr(f"concat(substring_index(content, '{text}', 1), substring(content, length(substring_index(content, '{text}', 1)) + {len(text)} + 1))"))
        assert (word, n) in {(r.word, r.n) for r in E.lost_content(raw, once).collect()}, text
    assert {(r.word, r.n) for r in E.lost_content(raw.where("doc_id = 1"), clean.where("false")).collect()} == {("word", 2), ("end", 1), ("a", 3), ("b", 2), ("c", 1), ("x", 3), ("y", 1)}


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_line_changes(spark):
    rng = random.Random(6)
    pairs = [("\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12))), "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))) for _ in range(400)]
    pairs += [("", ""), (None, "x"), ("x", None), (None, None), ("a\nb", "a\nb"), ("\n" * 3000 + "x", "y\n" + "\n" * 3000)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "doc_id long, content string, content_clean string")
    for r in E.line_changes(rows).collect():
        a, b = pairs[r.doc_id]
        a, b = (None if a is None else a.split("\n")), (None if b is None else b.split("\n"))
        kept = longest_common(a, b) if a is not None and b is not None and len(a) < 100 else 3000 if a and b else 0
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) if a is not None and b is not None else 0
        assert (r.n_kept, r.n_removed, r.n_added, r.same_until) == (kept, len(a or []) - kept, len(b or []) - kept, same), r
        if a and b and len(a) < 100:
            assert kept >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_audit_comes_from_the_cleaning_pass(spark):
    docs = reports(spark, DATA)
    audited = docs.select("doc_id", N.clean_with_audit("content").alias("c")).select("doc_id", "c.*")
    seen = Observation("cleaning")
    rows = audited.observe(seen, *N.audit_metrics("audit")).collect()
    plain = {r.doc_id: r.c for r in docs.select("doc_id", N.clean_markdown("content").alias("c")).collect()}
    assert {r.doc_id: r.content_clean for r in rows} == plain
    actions = [a.action.split()[0] for r in rows for a in r.audit]
    assert seen.get == {"documents": len(plain), **{k: actions.count(k) for k in ("list", "fallback", "removed")}} and min(map(actions.count, ("list", "fallback", "removed"))) > 0
    assert spark.createDataFrame([(None,)], "content string").select(N.clean_with_audit("content").alias("c")).first().c.content_clean is None


def test_sample_shaped_pair(spark):
    """A whole report: headings, a wide table with bold sub-headers, a simple table, prose."""
    raw = (
        "## PHẦN A  \r\n\r\n\r\n\r\n\r\nBáo cáo tháng 5.\t\r\n\r\n"
        "| STT | Nội dung | **Đơn vị** | Q1 | Q2 | Q3 | Q4 | Tổng | Ghi chú |  |\r\n|---|---|---|---|---|---|---|---|---|---|\r\n"
        "|  |  |  | **a** | **b** | **c** | **d** |  |  |  |\r\n"
        "| 1 | Sản xuất  - loại A  2. loại B | tấn | 10 | 20 |  | 40 | 70 | **gấp** | x |\r\n|  |  |  |  |  |  |  |  |  |  |\r\n| 2 | Bán | tấn |  |  |  |  | 5 |\r\n\r\n"
        "| a |  | b |\r\n|:-:|---|--:|\r\n| 1 |  | 22222 |\r\n\r\nHết."
    )
    clean = (
        "## PHẦN A\n\n\nBáo cáo tháng 5.\n\n"
        "**STT:** 1\n**Nội dung:**\n  - Sản xuất\n  - loại A\n  2. loại B\n**Đơn vị:** tấn\n**Q1:** 10\n**Q2:** 20\n**Q4:** 40\n**Tổng:** 70\n**Ghi chú:** **gấp**\n  - x"
        "\n\n---\n\n**STT:** 2\n**Nội dung:** Bán\n**Đơn vị:** tấn\n**Tổng:** 5\n\n"
        "| a   | b     |\n|-----|-------|\n| 1   | 22222 |\n\nHết."
    )
    docs = spark.createDataFrame([(1, raw)], "doc_id long, content string")
    assert docs.select(N.clean_markdown("content").alias("c")).first().c == clean
    assert spark.createDataFrame([(clean,)], "c string").select(N.clean_markdown("c").alias("c")).first().c == clean
    assert E.lost_content(docs, spark.createDataFrame([(1, clean)], "doc_id long, content string")).collect() == []


def test_look_ups_skip_row_groups(spark, tmp_path):
    ledger = spark.range(40_000).selectExpr("sha2(cast(id as string), 256) as job_id", "'p' as source_path", "'n' as original_filename", "'.html' as ext", "'done' as status", "cast(null as string) as error", "repeat('x', 100) as markdown")
    stored = S.write_ledger(ledger.repartition(8), f"file://{tmp_path}/ledger", jobs_per_file=40_000)
    one = S.stored_results(stored, [ledger.selectExpr("sha2('17', 256) as j").first().j])
    assert one.count() == 1
    filtered = S.stored_results(stored, ["f" * 40])
    assert filtered.count() == 0
    plan = filtered._jdf.queryExecution().executedPlan()
    filtered.collect()
    scans = [n for n in nodes(plan) if n.nodeName().startswith("Scan parquet")]
    assert sum(n.metrics().get("numOutputRows").get().value() for n in scans) == 0  # no row group's filter holds the id


def nodes(plan):
    while plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    out = [plan]
    children = plan.children()
    for i in range(children.size()):
        out += nodes(children.apply(i))
    return out
