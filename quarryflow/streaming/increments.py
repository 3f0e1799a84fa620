"""Incremental loads and event windows as Structured Streaming, over file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def append_new(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new and stop; the checkpoint is the watermark, so nothing is loaded twice."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type; a day closes when events are late past it."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by user and session: a gap ends one."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
