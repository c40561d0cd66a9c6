"""A stored ledger of conversions that grows by runs: what is known isn't converted again, and a run that is repeated replaces itself.

A ledger is a folder with two tables, both in one folder per run: seen (each file version that was looked at, and its job) and jobs
(LEDGER, one row per job, each job in the run that converted it). The run's seen rows come last: a run counts once they are there,
and one that broke off before is done again under its number. One run at a time may write; any number may read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.session import shared_folder
from mdloom.sources.files import DOCUMENT_EXTENSIONS, LEDGER, convert_jobs, document_files, job_ledger, many_files

SEEN = "source_path string, modified timestamp, length long, job_id string"
Converters = dict[str, Callable[[bytes], str]]


def stored(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the ledger with its column run; where nothing was written yet, one that Spark knows to be empty, so that no join
    with it moves anything."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    full = f"{schema}, run long"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full).where(F.lit(False))
    return spark.read.schema(full).parquet(f"{folder}/{name}")


def seen_files(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "seen", SEEN)


def stored_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "jobs", LEDGER)


def current_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """For each path the job of its last version: source_path, and the job's columns."""
    last = seen_files(spark, folder).groupBy("source_path").agg(F.max_by("job_id", F.struct("run", "modified")).alias("job_id"))
    jobs = stored_jobs(spark, folder).drop("source_path", "run")
    return last.join(jobs, "job_id")


def take_in(files: DataFrame, folder: str, run: int, converters: Converters | None = None) -> None:
    """Convert those of files (document_files with content) whose job no other run has, and write both tables of the run.

    Contents are read once: what is known gets no conversion but its row of seen. They move only for the join with the known ids, and
    not at all where Spark broadcasts these. Files of one name and content are one job; the least path stands for it.
    """
    spark = files.sparkSession
    known = stored_jobs(spark, folder).where(F.col("run") != run).select("job_id", F.lit(True).alias("known"))
    jobs = job_ledger(files).join(known, "job_id", "left").withColumn("content", F.when(F.col("known").isNull(), F.col("content")))
    staging = shared_folder(spark, "run")
    staged = convert_jobs(jobs, converters)
    with many_files(spark):
        staged.write.parquet(staging)
    staged = spark.read.schema(staged.schema).parquet(staging)
    columns = [c.split()[0] for c in LEDGER.split(", ")]
    once = staged.where("known is null").groupBy("job_id").agg(F.min_by(F.struct(*columns), "source_path").alias("row"))
    once.select("row.*").write.mode("overwrite").parquet(f"{folder}/jobs/run={run}")
    staged.select(*(c.split()[0] for c in SEEN.split(", "))).write.mode("overwrite").parquet(f"{folder}/seen/run={run}")


def convert_new(spark: SparkSession, source: str, folder: str, converters: Converters | None = None, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS) -> int:
    """Take in what is new or changed in source since the last run; returns the run's number, or that of the last if nothing is.

    The folder is listed once. Where files are known, the others are first told apart by path, time and length, for which no content
    is read. Only contents from the time of the oldest new file on are then read (a filter that reaches the scan), so a run over a
    large folder reads what came in. They are held against known files only where one of these is as late as that.
    """
    seen = seen_files(spark, folder)
    last = seen.agg(F.max("run")).first()[0] or 0
    files = document_files(spark, source, extensions)
    listed = files.select("path", "modified", "length")

    def unseen(df: DataFrame, known: DataFrame) -> DataFrame:
        version = (df.path == known.source_path) & df.modified.eqNullSafe(known.modified) & df.length.eqNullSafe(known.length)
        return df.join(known, version, "left_anti")

    with many_files(spark):
        if last:
            since = unseen(listed, seen).agg(F.min("modified")).first()[0]
            if since is None:
                return last
            files, late = files.where(F.col("modified") >= F.lit(since)), seen.where(F.col("modified") >= F.lit(since))
            files = files if late.first() is None else unseen(files, late)
        elif listed.first() is None:
            return last
    take_in(files, folder, last + 1, converters)
    return last + 1


def stream_new(spark: SparkSession, source: str, folder: str, converters: Converters | None = None, extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS, per_batch: int | None = None):
    """A stream of the files that arrive in source into the ledger, ready to start(): each batch is the run of its number, so a batch
    that is done again replaces what it wrote. Successes and failures are rows of one table, told apart by their status."""
    files = document_files(spark, source, extensions, per_batch=per_batch, stream=True)

    def keep(batch: DataFrame, number: int) -> None:
        take_in(batch, folder, number + 1, converters)

    return files.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
