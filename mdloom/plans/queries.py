"""The registered queries of the Markdown engine, by SURVEY key."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions import text as X
from mdloom.functions.html import html_to_markdown
from mdloom.operators import exploded as E
from mdloom.operators import narrow as N
from mdloom.plans.reports import html_pages, reports, roughened
from mdloom.session import shared_folder, table
from mdloom.sources import files as S
from mdloom.sources import ledger as L
from mdloom.sources.sink import export_files
from mdloom.streaming import streams as Z
from mdloom.streaming import timers as T

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tables_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.md_tables(reports(spark, sf_dir))


def exported_pages(spark: SparkSession, sf_dir: str) -> str:
    """Every page as a file, its suffix by page_id % 4."""
    ext = F.element_at(F.array(*map(F.lit, (".html", ".HTML", ".docx", ".png"))), (F.col("page_id") % 4 + 1).cast("int"))
    folder = shared_folder(spark, "pages")
    export_files(table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), "page_id", ext).alias("name"), "html"), folder, "name", "html")
    return folder


def ledger_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.convert_documents(S.scan_documents(spark, exported_pages(spark, sf_dir)))


@query
def scan_documents(spark, sf_dir):
    return S.scan_documents(spark, exported_pages(spark, sf_dir)).select("original_filename", "ext", "length", F.sha2("content", 256).alias("content_sha"))


@query
def scan_markdown(spark, sf_dir):
    folder = shared_folder(spark, "markdown")
    export_files(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(E.ordered("text", "turn"), "\n\n").alias("text")).select(F.concat("conv_id", F.lit(".md")).alias("name"), "text"), folder, "name", "text")
    return S.scan_markdown(spark, folder).select("file_name", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha"))


@query
def job_ledger(spark, sf_dir):
    return S.job_ledger(S.scan_documents(spark, exported_pages(spark, sf_dir))).select("job_id", "original_filename", "ext")


@query
def convert_documents(spark, sf_dir):
    return ledger_of(spark, sf_dir).select("job_id", "original_filename", "ext", "status", "error", "markdown")


def arrivals(spark: SparkSession, sf_dir: str, folder: str):
    """Pages as files in two goes: those of even ids, then the others and changed ones of every tenth id; yields after each."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), "page_id", F.when(F.col("page_id") % 4 < 2, ".html").otherwise(".docx")).alias("name"), "page_id", "html")
    export_files(pages.where("page_id % 2 = 0"), folder, "name", "html")
    yield
    changed = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<p>changed</p>"))).otherwise(F.col("html"))
    export_files(pages.where("page_id % 2 = 1 or page_id % 10 = 0").withColumn("html", changed), folder, "name", "html")
    yield


@query
def incremental_conversion(spark, sf_dir):
    """Three runs over a folder: half of the files, the rest and some that changed, and nothing new. Every job of the ledger."""
    files, ledger = shared_folder(spark, "arriving"), shared_folder(spark, "ledger")
    for _ in arrivals(spark, sf_dir, files):
        L.convert_new(spark, files, ledger)
    L.convert_new(spark, files, ledger)
    return L.stored_jobs(spark, ledger).drop("source_path")


@query
def current_jobs(spark, sf_dir):
    """The same folder; each file's last version."""
    files, ledger = shared_folder(spark, "arriving"), shared_folder(spark, "ledger")
    for _ in arrivals(spark, sf_dir, files):
        L.convert_new(spark, files, ledger)
    return L.current_jobs(spark, ledger).drop("source_path")


@query
def stream_conversion(spark, sf_dir):
    """Files that arrive between two starts of a stream, each converted once; new names only, as a file stream knows files by name."""
    files, ledger = shared_folder(spark, "arriving"), shared_folder(spark, "ledger")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page"), "page_id", F.when(F.col("page_id") % 4 < 2, ".html").otherwise(".docx")).alias("name"), "html")
    for half in (0, 1):
        export_files(pages.where(F.col("page_id") % 2 == half), files, "name", "html")
        L.stream_new(spark, files, ledger).start().awaitTermination()
    return L.stored_jobs(spark, ledger).drop("source_path", "run")


@query
def failed_jobs(spark, sf_dir):
    return S.failed_jobs(ledger_of(spark, sf_dir))


@query
def status_by_ext(spark, sf_dir):
    return S.status_by_ext(ledger_of(spark, sf_dir))


@query
def result_records(spark, sf_dir):
    return S.result_records(ledger_of(spark, sf_dir)).select("record.*")


@query
def lookup_jobs(spark, sf_dir):
    """Asks for the job of every page (some have none), and for as many ids that no job has."""
    ledger = ledger_of(spark, sf_dir)
    pages = table(spark, sf_dir, "pages")
    ext = F.element_at(F.array(*map(F.lit, (".html", ".HTML", ".docx", ".png"))), (F.col("page_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("page"), "page_id", ext)
    wanted = pages.select(F.sha2(F.concat(name.cast("binary"), F.lit("\n").cast("binary"), F.col("html").cast("binary")), 256).alias("job_id"))
    return S.lookup_jobs(ledger, wanted.unionByName(pages.select(F.concat(F.lit("none"), "page_id").alias("job_id"))))


@query
def stored_results(spark, sf_dir):
    """A stored ledger asked for its first and last job and for one that it doesn't hold."""
    stored = S.write_ledger(ledger_of(spark, sf_dir), shared_folder(spark, "ledger"))
    ends = stored.agg(F.min("job_id").alias("a"), F.max("job_id").alias("b")).first()
    return S.stored_results(stored, [*(x for x in ends if x), "none"])


@query
def pages_to_markdown(spark, sf_dir):
    return S.pages_to_markdown(table(spark, sf_dir, "pages"))


@query
def html_tables(spark, sf_dir):
    """Pages with tables, raw and cleaned."""
    raw = html_pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), html_to_markdown("html").alias("markdown"))
    return raw.select("doc_id", "markdown", N.clean_markdown("markdown").alias("content_clean"))


@query
def write_clean(spark, sf_dir):
    return S.write_clean(reports(spark, sf_dir), shared_folder(spark, "clean"))


@query
def table_lines(spark, sf_dir):
    return E.md_lines(reports(spark, sf_dir)).where("is_table_line").select("doc_id", "line_no", "line")


@query
def separator_rows(spark, sf_dir):
    return E.md_rows(tables_of(spark, sf_dir)).where("is_sep").select("doc_id", "table_no", "row_no", "line")


@query
def table_stats(spark, sf_dir):
    return N.table_stats(reports(spark, sf_dir)).drop("is_complex")


@query
def table_stats_exploded(spark, sf_dir):
    return E.table_stats(tables_of(spark, sf_dir)).drop("is_complex")


@query
def complex_tables(spark, sf_dir):
    return N.table_stats(reports(spark, sf_dir)).where("is_complex").select("doc_id", "table_no", "n_cols", "max_cell_len")


@query
def md_lines(spark, sf_dir):
    return E.md_lines(reports(spark, sf_dir))


@query
def table_blocks(spark, sf_dir):
    runs = E.md_runs(reports(spark, sf_dir)).where("is_table_line")
    return runs.select("doc_id", "table_no", F.col("start").alias("first_line_no"), F.size("lines").cast("long").alias("n_lines"))


@query
def md_cells(spark, sf_dir):
    return E.md_cells(tables_of(spark, sf_dir))


@query
def subheader_rows(spark, sf_dir):
    return E.subheader_rows(tables_of(spark, sf_dir))


@query
def empty_columns(spark, sf_dir):
    return E.empty_columns(tables_of(spark, sf_dir))


@query
def drop_empty_columns(spark, sf_dir):
    return E.drop_empty_columns(tables_of(spark, sf_dir))


@query
def column_widths(spark, sf_dir):
    return E.column_widths(tables_of(spark, sf_dir))


@query
def header_names(spark, sf_dir):
    return E.header_names(tables_of(spark, sf_dir))


@query
def table_records(spark, sf_dir):
    return E.table_records(tables_of(spark, sf_dir)).select("doc_id", "table_no", "row_no", "data_row_no")


@query
def md_fields(spark, sf_dir):
    return E.md_fields(tables_of(spark, sf_dir))


@query
def format_cells(spark, sf_dir):
    cells = E.md_cells(tables_of(spark, sf_dir)).where("col_no is not null")
    return cells.select("doc_id", "table_no", "row_no", "col_no", X.format_cell("cell").alias("formatted"))


@query
def structured_items(spark, sf_dir):
    """The list items of every cell of more than one line."""
    fields = E.md_fields(tables_of(spark, sf_dir)).where("is_multiline")
    return fields.select("doc_id", "table_no", "data_row_no", "col_no", X.items(X.format_cell("value")).alias("items"))


@query
def structured_lists(spark, sf_dir):
    return E.structured_lists(tables_of(spark, sf_dir))


@query
def rebuild_tables(spark, sf_dir):
    return E.rebuild_tables(tables_of(spark, sf_dir))


@query
def table_to_markdown(spark, sf_dir):
    """Each order's items as a Markdown table."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    return E.table_to_markdown(items, ["l_orderkey"], columns, columns)


@query
def clean_tables(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", N.clean_tables(X.normalize_endings("content")).alias("content"))


@query
def clean_tables_exploded(spark, sf_dir):
    return E.clean_tables_exploded(reports(spark, sf_dir))


@query
def clean_markdown(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", N.clean_markdown("content").alias("content_clean"))


@query
def clean_documents(spark, sf_dir):
    return roughened(spark, sf_dir).select("doc_id", N.clean_markdown("content").alias("content_clean"))


@query
def raw_vs_clean(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", "content", N.clean_markdown("content").alias("content_clean"))


@query
def lost_content(spark, sf_dir):
    return E.lost_words(reports(spark, sf_dir).select("doc_id", "content", N.clean_markdown("content").alias("content_clean")))


@query
def planted_losses(spark, sf_dir):
    """What is found missing when every fifth document loses its last line."""
    docs = reports(spark, sf_dir).select("doc_id", "content", N.clean_markdown("content").alias("whole"))
    cut = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("whole", r"\n[^\n]*\z", "")).otherwise(F.col("whole"))
    return E.lost_words(docs.select("doc_id", "content", cut.alias("content_clean")))


@query
def line_changes(spark, sf_dir):
    return E.line_changes(reports(spark, sf_dir).select("doc_id", "content", N.clean_markdown("content").alias("content_clean")))


@query
def clean_with_audit(spark, sf_dir):
    """Cleaned texts and their audit from one scan."""
    both = reports(spark, sf_dir).select("doc_id", N.clean_with_audit("content").alias("c"))
    return both.select("doc_id", "c.content_clean", F.array_join(F.transform("c.audit", lambda a: F.concat_ws(" ", a["first_line"], a["action"])), ", ").alias("audit"))


@query
def table_audit(spark, sf_dir):
    action = F.when(F.col("route") == "R2", "list").when(F.col("route") == "R3", "fallback").otherwise(F.concat(F.lit("removed "), "n_empty_cols"))
    return N.table_stats(reports(spark, sf_dir)).where("route in ('R2', 'R3', 'R4')").select("doc_id", "first_line", action.alias("action"))


@query
def route_counts(spark, sf_dir):
    return N.table_stats(reports(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


@query
def normalize_endings(spark, sf_dir):
    return roughened(spark, sf_dir).select("doc_id", X.normalize_endings("content").alias("content"))


@query
def strip_line_ends(spark, sf_dir):
    return roughened(spark, sf_dir).select("doc_id", X.strip_line_ends(X.normalize_endings("content")).alias("content"))


@query
def cleanup_whitespace(spark, sf_dir):
    return roughened(spark, sf_dir).select("doc_id", X.cleanup_whitespace(X.normalize_endings("content")).alias("content"))


@query
def nonempty_docs(spark, sf_dir):
    """Lines of documents as documents of their own, blank ones left out."""
    lines = E.md_lines(roughened(spark, sf_dir)).select("doc_id", "line_no", "line")
    return S.nonempty(lines, "line")


@query
def doc_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query
def output_names(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".tar.gz", "", ".md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/doc-"), "doc_id", ext).alias("name"))
    return named.select("doc_id", X.output_name("name").alias("output_name"), X.ensure_suffix("name").alias("with_suffix"), X.extension("name").alias("ext"))


@query
def progress_percent(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.floor("l_quantity").alias("loaded"), (F.col("l_partkey") % 60).alias("total"))
    return items.select("loaded", "total", X.percent_done("loaded", "total").alias("percent"))


STAGE_OF = "element_at(array('uploading', 'extracting', 'generating', 'formatting', 'complete', 'error', 'idle'), cast(event_id % 7 + 1 as int))"


@query
def stage_index(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(STAGE_OF).alias("stage")).withColumn("stage_no", X.stage_index("stage"))


@query
def stream_clean(spark, sf_dir):
    folder = shared_folder(spark, "stream-clean")
    source = Z.read_stream(spark, sf_dir, "documents").selectExpr("doc_id", "replace(text, '\n', '  \r\n\t\n\n\r\r\n') as content")
    Z.stream_clean(source, folder).start().awaitTermination()
    return spark.read.schema("doc_id long, content_clean string").parquet(f"{folder}/data")


@query
def debounced_latest(spark, sf_dir):
    edits = Z.read_stream(spark, sf_dir, "events").selectExpr("user_id as key", "cast(ts as timestamp) as ts", "event_id as content")
    out = Z.run_complete(Z.debounced_latest(edits, "6 hours", "60 days"), shared_folder(spark, "debounced"))
    return out.selectExpr("key", "cast(started as timestamp_ntz) as started", "cast(saved as timestamp_ntz) as saved", "content")


@query
def job_progress(spark, sf_dir):
    """In update mode over several batches: the events in eight files, two to a batch."""
    folder = shared_folder(spark, "events")
    table(spark, sf_dir, "events").repartition(8, "event_id").write.parquet(f"{folder}/events.parquet")
    stages = Z.read_stream(spark, folder, "events", per_batch=2).selectExpr("user_id as job", "ts", f"{STAGE_OF} as stage")
    return Z.run_update(Z.job_progress(stages), shared_folder(spark, "progress"), ["job"])


@query
def stage_counts(spark, sf_dir):
    stages = Z.read_stream(spark, sf_dir, "events").selectExpr("cast(ts as timestamp) as ts", f"{STAGE_OF} as stage")
    return Z.run_complete(Z.stage_counts(stages), shared_folder(spark, "stages")).selectExpr("cast(started as timestamp_ntz) as started", "stage", "n")


def slices_of_events(spark: SparkSession, sf_dir: str, folder: str, n: int = 2):
    """The events put into a folder in n goes, in the order of time; yields after each."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    span = events.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    for i in range(n):
        low, high = ((span.a or 0) + ((span.b or 0) - (span.a or 0) + 1) * k // n for k in (i, i + 1))
        events.where((F.col("at") >= low) & (F.col("at") < high)).drop("at").write.mode("append").parquet(f"{folder}/events.parquet")
        yield


def closed_bursts(spark, sf_dir, debounced):
    """Bursts that the watermark has passed, over two starts of one stream in append mode."""
    source, out = shared_folder(spark, "slices"), shared_folder(spark, "bursts")
    with T.with_state_store(spark):
        for _ in slices_of_events(spark, sf_dir, source):
            edits = Z.read_stream(spark, source, "events").selectExpr("user_id as key", "cast(ts as timestamp) as ts", "cast(event_id as string) as content")
            done = Z.run_append(debounced(edits), out)
    return done.selectExpr("key", "cast(started as timestamp_ntz) as started", "cast(saved as timestamp_ntz) as saved", "content")


@query
def debounced_append(spark, sf_dir):
    return closed_bursts(spark, sf_dir, lambda edits: Z.debounced_latest(edits, "6 hours", "1 hour"))


@query
def debounced_by_timer(spark, sf_dir):
    return closed_bursts(spark, sf_dir, lambda edits: T.debounced_by_timer(edits, timedelta(hours=6), "1 hour"))


@query
def progress_until_done(spark, sf_dir):
    """The last news of each job, from state that forgets jobs when they end."""
    source, out = shared_folder(spark, "slices"), shared_folder(spark, "progress")
    with T.with_state_store(spark):
        for _ in slices_of_events(spark, sf_dir, source):
            stages = Z.read_stream(spark, source, "events").selectExpr("user_id as job", "cast(ts as timestamp) as ts", f"{STAGE_OF} as stage")
            done = Z.run_update(T.progress_until_done(stages), out, ["job"])
    return done.selectExpr("job", "stage", "cast(ts as timestamp_ntz) as ts")
