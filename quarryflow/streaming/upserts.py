"""Streams into keyed tables: idempotent upserts by batch, duplicates within a watermark, joins of two streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryflow.operators.filetable import merge_files


def upsert(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Keep the newest row of each key, by order, in the table at path; takes what is there and stops.

    A batch is merged under its number: one that a restart repeats after it was written changes nothing, and one that
    was written in part is finished first. Only files that hold a key of the batch are rewritten.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_files(batch.sparkSession, path, batch, keys, order, token=f"batch-{number}", newest=True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, keys: Sequence[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; a repeated one is dropped if it comes within late of it. time is a timestamp."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def followed_by(first: DataFrame, then: DataFrame, key: str, time: str, within: str, late: str = "1 day") -> DataFrame:
    """a, b (structs): rows of first with those of then that have the same key and come at most within after them.

    Both are streams; watermarks let Spark forget rows that no later row can meet.
    """
    side = lambda df, name: df.select(F.struct(*df.columns).alias(name), F.col(key).alias(f"{name}_key"), F.col(time).alias(f"{name}_time")).withWatermark(f"{name}_time", late)
    near = F.expr(f"a_key = b_key AND b_time >= a_time AND b_time <= a_time + INTERVAL {within}")
    return side(first, "a").join(side(then, "b"), near).select("a", "b")
