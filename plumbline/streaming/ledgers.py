"""Structured Streaming forms of append-only results: resume by key, running ledgers and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """New record files of a folder, in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def first_results(stream: DataFrame, keys: list[str], event_time: str, late: str = "1 hour") -> DataFrame:
    """Each key's first row; state older than the watermark goes."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def attempts(stream: DataFrame, keys: list[str], event_time: str = "at", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Failures, successes and the last error of each key and window; a window's state goes once the watermark has passed it."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), *keys).agg(F.count_if("failed").alias("failures"), F.count_if(~F.col("failed")).alias("successes"), F.max_by("error", F.when(F.col("failed"), F.col(event_time))).alias("last_error"))


def windowed_counts(stream: DataFrame, event_time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), *by).agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Takes all that is there and ends; run again, it goes on where it stopped."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
