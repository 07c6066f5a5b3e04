"""Ingestion as a stream of files: chunks with ids that a replay repeats, so a restarted stream writes nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources import files


def stream(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 1000, tasks: str | None = None) -> None:
    """Takes in every text file of `source` that the checkpoint doesn't know yet, then stops. sink: one folder a batch, overwritten if the batch is repeated.
    tasks: a table that gets each batch's states, STARTED then SUCCESS or FAILURE."""
    incoming = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(source).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def batch(df: DataFrame, number: int) -> None:
        say = (lambda status, at: append_task(spark, tasks, f"batch-{number}", status, at)) if tasks else (lambda status, at: None)
        say("STARTED", 2 * number)
        try:
            files.chunks(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        except Exception:
            say("FAILURE", 2 * number + 1)
            raise
        say("SUCCESS", 2 * number + 1)

    incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_task(spark: SparkSession, path: str, task_id: str, status: str, seq: int) -> None:
    """A state of a task, as a row; task_status() tells the latest."""
    spark.createDataFrame([(task_id, status, seq)], "task_id string, status string, seq long").coalesce(1).write.mode("append").parquet(path)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """The same for rows: doc_id, text as chunk rows."""
    return files.chunks(docs.select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("path"), "text"))


def task_status(events: DataFrame) -> DataFrame:
    """The latest state of each ingestion task."""
    return events.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


