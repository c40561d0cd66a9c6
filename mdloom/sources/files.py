"""Documents from files and pages, the job ledger, and the sinks."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.functions.html import html_to_markdown
from mdloom.functions.text import extension, strip
from mdloom.operators.narrow import clean_markdown

#: What can be converted, and what can be opened as Markdown.
DOCUMENT_EXTENSIONS = (".pdf", ".docx", ".doc", ".pptx", ".html")
MARKDOWN_EXTENSIONS = (".md", ".markdown", ".txt")
#: Seconds that one file may take a converter.
TIME_LIMIT = 300.0
#: What opening a file counts for, in bytes, where a scan is parted into tasks.
OPEN_COST = 256 << 10
LEDGER = "job_id string, source_path string, original_filename string, ext string, status string, error string, markdown string"


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def any_case(extensions: tuple[str, ...]) -> str:
    """A file-name pattern for these suffixes in any case, so that other files are never opened."""
    letters = ("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in extensions)
    return "{" + ",".join(f"*{ext}" for ext in letters) + "}"


@contextmanager
def many_files(spark: SparkSession):
    """Scans that run within take some 500 small files to a task where there are many, not 31 as by Spark's usual cost of opening a file
    (4 MB, of 128 MB to a task), so that tasks don't outweigh their work; the session's own choice is put back."""
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)


def document_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS, stream: bool = False, per_batch: int | None = None) -> DataFrame:
    """path, original_filename, ext, modified, length, content of the files that can be converted, as a table or as a stream of
    those that arrive; the suffix counts in any case."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(extensions))
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
        reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader
    named = reader.load(folder).withColumn("original_filename", base_name("path")).withColumn("ext", F.lower(extension("original_filename")))
    return named.where(F.col("ext").isin(*extensions)).select("path", "original_filename", "ext", F.col("modificationTime").alias("modified"), "length", "content")


def scan_documents(spark: SparkSession, folder: str, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS) -> DataFrame:
    """path, original_filename, ext, length, content of the files that can be converted."""
    return document_files(spark, folder, extensions).drop("modified")


def scan_markdown(spark: SparkSession, folder: str, extensions: tuple[str, ...] = MARKDOWN_EXTENSIONS) -> DataFrame:
    """file_name, content of Markdown and text files, each as one text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(extensions)).text(folder, wholetext=True)
    named = files.select(base_name("_metadata.file_path").alias("file_name"), F.col("value").alias("content"))
    return named.where(F.lower(extension("file_name")).isin(*extensions))


def job_ledger(files: DataFrame) -> DataFrame:
    """A job per file. Its id is a hash of name and content, so a second run makes the same ones."""
    job = F.sha2(F.concat(F.col("original_filename").cast("binary"), F.lit("\n").cast("binary"), F.col("content")), 256)
    more = [c for c in ("modified", "length") if c in files.columns]
    return files.select(job.alias("job_id"), F.col("path").alias("source_path"), "original_filename", "ext", *more, "content")


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", clean_markdown(html_to_markdown("html")).alias("markdown"))


def convert_documents(files: DataFrame, converters: dict[str, Callable[[bytes], str]] | None = None, seconds: float = TIME_LIMIT) -> DataFrame:
    """The ledger of all files, converted and cleaned in one scan: HTML by expressions, other kinds by a converter of the user's own.

    A converter runs in Arrow batches, which HTML doesn't enter; what it raises becomes the row's error, and other rows go on.
    HTML that isn't UTF-8 and kinds without a converter fail with a message.
    """
    return convert_jobs(job_ledger(files), converters, seconds)


def convert_jobs(jobs: DataFrame, converters: dict[str, Callable[[bytes], str]] | None = None, seconds: float = TIME_LIMIT) -> DataFrame:
    """The same for jobs with their contents (job_ledger)."""
    converters = converters or {}
    is_html = F.col("ext") == ".html"
    html = F.try_validate_utf8(F.col("content").cast("string"))
    missing = F.concat(F.lit("no converter for "), "ext")
    if converters:
        jobs = jobs.withColumn("own", converted_by(converters, seconds)(F.when(~is_html, F.col("content")), F.when(~is_html, F.col("ext"))))
        other, why = F.col("own.raw"), F.coalesce("own.error", F.when(~F.col("ext").isin(*converters), missing))
    else:
        other, why = F.lit(None).cast("string"), missing
    raw = F.when(is_html, html_to_markdown(html)).otherwise(other)
    error = F.when(is_html, F.when(html.isNull(), "not UTF-8")).otherwise(why)
    more = [c for c in ("modified", "length", "known") if c in jobs.columns]
    done = jobs.select("job_id", "source_path", "original_filename", "ext", raw.alias("raw"), error.alias("error"), *more)
    status = F.when(F.col("error").isNull(), "done").otherwise("failed")
    return done.select("job_id", "source_path", "original_filename", "ext", status.alias("status"), "error", clean_markdown("raw").alias("markdown"), *more)


@contextmanager
def time_limit(seconds: float):
    """Raises TimeoutError in what runs within once the time is up, by a signal to this worker's main thread: at the next Python step,
    so a call into other code that never comes back isn't stopped. Where signals can't be used, there is no limit."""

    def stop(signum, frame):
        raise TimeoutError(f"no result within {seconds:g} s")

    if not hasattr(signal, "setitimer") or threading.current_thread() is not threading.main_thread():
        yield
        return
    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def converted_by(converters: dict[str, Callable[[bytes], str]], seconds: float = TIME_LIMIT):
    """(content, ext) to a struct (raw, error); both null where there is no content or no converter. A file that takes a converter
    longer than the time limit fails with a message, and others go on."""

    @F.pandas_udf("raw string, error string")
    def run(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
        raw, errors = [], []
        for data, kind in zip(content, ext, strict=True):
            text = error = None
            if kind in converters and data is not None:
                try:
                    with time_limit(seconds):
                        text = converters[kind](bytes(data))
                except Exception as e:  # one file's failure is that file's result
                    error = str(e) or type(e).__name__
            raw.append(text)
            errors.append(error)
        return pd.DataFrame({"raw": raw, "error": errors}, dtype=object)

    return run


def failed_jobs(ledger: DataFrame) -> DataFrame:
    return ledger.where("error is not null").select("job_id", "original_filename", "ext", "error")


def status_by_ext(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("ext", "status").agg(F.count("*").alias("n"))


def result_records(ledger: DataFrame) -> DataFrame:
    """One struct (success, job_id, original_filename, markdown) per job."""
    return ledger.select("job_id", F.struct(F.col("error").isNull().alias("success"), "job_id", "original_filename", "markdown").alias("record"))


def lookup_jobs(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted job_id its output, or found = false."""
    return wanted.join(ledger.select("job_id", "markdown", F.lit(True).alias("hit")), "job_id", "left").select("job_id", F.coalesce("hit", F.lit(False)).alias("found"), "markdown")


def write_ledger(ledger: DataFrame, folder: str, jobs_per_file: int = 1_000_000) -> DataFrame:
    """The ledger as Parquet, in ranges of job_id and sorted in each, with a Bloom filter on job_id in every row group: a look-up by
    id reads the row groups whose range and filter fit. jobs_per_file sizes the filters; more jobs make them let more pass."""
    sorted_ = ledger.repartitionByRange("job_id").sortWithinPartitions("job_id")
    options = {"parquet.bloom.filter.enabled#job_id": "true", "parquet.bloom.filter.expected.ndv#job_id": str(jobs_per_file), "parquet.bloom.filter.adaptive.enabled": "true"}
    sorted_.write.mode("overwrite").options(**options).parquet(folder)
    return ledger.sparkSession.read.schema(LEDGER).parquet(folder)


def stored_results(stored: DataFrame, job_ids: list[str]) -> DataFrame:
    """The results of a few jobs of a stored ledger: a filter that reaches the Parquet scan, no join."""
    return result_records(stored.where(F.col("job_id").isin(job_ids))).select("record.*")


def write_clean(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, content_clean as Parquet; what was written, read again."""
    docs.select("doc_id", clean_markdown("content").alias("content_clean")).write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def nonempty(docs: DataFrame, text_col: str = "content") -> DataFrame:
    return docs.where(strip(text_col) != "")
