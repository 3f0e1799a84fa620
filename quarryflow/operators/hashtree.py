"""Reconciliation by hash trees: checksums by buckets of keys, drilled down only where two sides differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryflow.operators.graph import cut
from quarryflow.operators.reconcile import value_diff

#: Levels at most, of 16 buckets each: a tree has 16 ** DEPTH leaves at most, which may be broadcast.
DEPTH = 5
#: Rows in a leaf, about.
LEAF = 256


def row_text(columns: Sequence[str | Column]) -> Column:
    """One text of all columns in which nulls differ from any value."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in parts))


def row_number_of(text: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 as a number."""
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")


def checksum(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """One row: row_count and the sum of all rows' numbers, as text; no order of rows changes it."""
    return df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(row_number_of(row_text(columns))), F.lit(0)).cast("string").alias("checksum"))


def bucket(keys: Sequence[str], depth: int) -> Column:
    return F.substr(F.md5(row_text(keys).cast("binary")), F.lit(1), F.lit(depth))


def tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int) -> DataFrame:
    """level, bucket, n, total for levels 1 to depth. One aggregation over df; upper levels are sums of the leaves."""
    leaves = df.groupBy(bucket(keys, depth).alias("leaf")).agg(F.count("*").alias("n"), F.sum(row_number_of(row_text([*keys, *columns]))).alias("total"))
    each = cut(leaves).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth))))
    return each.groupBy("level", F.substr(F.col("leaf"), F.lit(1), F.col("level")).alias("bucket")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def drilled(source: DataFrame, target: DataFrame, depth: int) -> DataFrame:
    """level, bucket, n_source, n_target: the buckets that differ, level by level; only children of such are compared."""
    side = lambda df, k, name: df.where(F.col("level") == k).select("bucket", F.col("n").alias(f"n_{name}"), F.col("total").alias(f"total_{name}"))
    found, parents = None, None
    for k in range(1, depth + 1):
        one, two = side(source, k, "source"), side(target, k, "target")
        if parents is not None:
            of = F.substr(F.col("bucket"), F.lit(1), F.lit(k - 1)) == F.col("_parent")
            one, two = (x.join(F.broadcast(parents), of, "left_semi") for x in (one, two))  # 16 ** DEPTH rows at most
        both = one.join(two, "bucket", "full").where("NOT (n_source <=> n_target AND total_source <=> total_target)")
        both = cut(both.select(F.lit(k).alias("level"), "bucket", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_source", "n_target"))))
        parents = both.select(F.col("bucket").alias("_parent"))
        found = both if found is None else found.union(both)
    return found


def tree_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int | None = None) -> DataFrame:
    """What value_diff() gives, by shuffling only the rows of leaves that differ. Keys are unique on each side."""
    if depth is None:
        n, depth = source.count(), 1
        while depth < DEPTH and LEAF * 16**depth < n:
            depth += 1
    leaves = drilled(tree(source, keys, columns, depth), tree(target, keys, columns, depth), depth).where(F.col("level") == depth)
    leaves = F.broadcast(leaves.select(F.col("bucket").alias("_leaf")))
    some = lambda df: df.join(leaves, bucket(keys, depth) == F.col("_leaf"), "left_semi")
    return value_diff(some(source), some(target), keys, columns)
