"""Incremental ingestion of a change log by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import crawl
from lodestone.plans.engine import Engine


def changes(spark: SparkSession, log_folder: str, files_a_batch: int = 100) -> DataFrame:
    """The change log as a stream of ts, action, path; offsets are the checkpoint's, and files_a_batch bounds what a batch takes in."""
    return crawl.change_log(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(log_folder))


def follow(stream: DataFrame, read: Callable[[DataFrame], DataFrame], engine: Engine, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each batch's paths, the last action of each, are read (to file_path, text), and their chunks and vectors put in place of the files'; deleted files lose theirs.

    A batch that is delivered again changes nothing: the version that it made names its batch, and a version is there
    whole or not at all.
    """

    def batch(df: DataFrame, number: int) -> None:
        if engine.chunks.properties().get("batch", -1) >= number:
            return
        last = df.groupBy("path").agg(F.max_by("action", "ts").alias("action")).persist()
        got = read(last.filter("action != 'delete'").select("path")).select("file_path", "text").persist()
        gone = last.filter("action = 'delete'").select(F.col("path").alias("file_path"))
        engine.replace(got, gone, batch=number)
        got.unpersist()
        last.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
