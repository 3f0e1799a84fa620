"""Incremental loads on immutable files: each gives the table's new content as a DataFrame to write."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without(target: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of target whose keys held lacks; null is a key like others."""
    held = held.select(*(F.col(k).alias(f"_held_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in keys]
    return target.join(held, reduce(lambda a, b: a & b, same), "left_anti")


def delete_insert(target: DataFrame, increment: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Rows of target in partitions that increment holds are replaced by increment."""
    return without(target, increment, partition).unionByName(increment)


def write_partitions(increment: DataFrame, path: str, partition: Sequence[str]) -> None:
    """The same in place: only the partitions that increment holds are overwritten."""
    increment.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest source row of each key, by order, replaces or joins target. Ties go to the least hash of the row."""
    latest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order), F.xxhash64(*source.columns))
    new = source.withColumn("_turn", F.row_number().over(latest)).where("_turn = 1").drop("_turn")
    return without(target, new, keys).unionByName(new)


def watermark_append(target: DataFrame, source: DataFrame, column: str) -> DataFrame:
    """target and the rows of source past target's largest value; all of source where target has none."""
    mark = target.agg(F.max(column).alias("_mark"))
    fresh = source.crossJoin(F.broadcast(mark)).where(F.col("_mark").isNull() | (F.col(column) > F.col("_mark"))).drop("_mark")  # one row
    return target.unionByName(fresh)


def update(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE target SET values WHERE condition, as the table's new content; a null condition leaves the row alone."""
    return target.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def full_refresh(source: DataFrame, path: str) -> None:
    source.write.mode("overwrite").parquet(path)
