"""Continuous cleaning, debounced drafts and job progress with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdloom.operators.narrow import clean_markdown


def stream_clean(source: DataFrame, folder: str):
    """Clean each arriving document once and append it as Parquet; stateless. source: doc_id, content."""
    cleaned = source.select("doc_id", clean_markdown("content").alias("content_clean"))
    return cleaned.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/data").outputMode("append").trigger(availableNow=True)


def debounced_latest(edits: DataFrame, gap: str = "1000 milliseconds", late: str = "1 hour") -> DataFrame:
    """Per burst of edits of a key, the last content; a burst ends when no edit comes within the gap. edits: key, ts,
    content. In append mode a burst comes once, when the watermark has passed its end, and its state goes; edits later than
    the watermark are dropped. In complete mode all bursts stay."""
    timed = edits.withWatermark("ts", late) if edits.isStreaming else edits
    bursts = timed.groupBy("key", F.session_window("ts", gap).alias("burst")).agg(F.max_by("content", F.struct("ts", "content")).alias("content"))
    return bursts.select("key", F.col("burst.start").alias("started"), F.col("burst.end").alias("saved"), "content")


def job_progress(stages: DataFrame) -> DataFrame:
    """The latest stage of each job; stages: job, ts, stage. State grows with the number of jobs, a row each."""
    return stages.groupBy("job").agg(F.max_by("stage", F.struct("ts", "stage")).alias("stage"), F.max("ts").alias("ts"))


def stage_counts(stages: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Stages by tumbling window."""
    timed = stages.withWatermark("ts", late) if stages.isStreaming else stages
    return timed.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "stage", "n")


def read_stream(spark: SparkSession, sf_dir: str, name: str, per_batch: int | None = None) -> DataFrame:
    """A table as a stream of its files (a folder, or the one file of that name), at most per_batch of them in a batch."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(f"{path}*")


def run_append(result: DataFrame, folder: str) -> DataFrame:
    """Run an aggregating stream with a watermark over what is there; returns what it closed, each row written once."""
    result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/data").trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/data")


def run_update(result: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream in update mode: each batch writes only the rows that it changed, into a folder of its own number,
    so a batch that runs twice leaves one copy. Returns the last row of each key."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={number}")

    result.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    changed = result.sparkSession.read.option("basePath", f"{folder}/changed").parquet(f"{folder}/changed")
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*result.columns), F.col("batch").cast("long")).alias("row"))
    return last.select("row.*")


def run_complete(result: DataFrame, folder: str) -> DataFrame:
    """Run an aggregating stream over what is there and return its last full result."""
    spark = result.sparkSession

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    result.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/result")
