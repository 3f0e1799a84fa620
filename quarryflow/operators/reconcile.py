"""Reconciliation of a source and a target table, with measured results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryflow.operators.incremental import without


def row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """platform, row_count: one row a side."""
    one = lambda df, name: df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("platform"), "row_count")
    return one(source, "source").union(one(target, "target"))


def distinct_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """platform, distinct_count: distinct rows of each side; nulls equal nulls."""
    one = lambda df, name: df.distinct().agg(F.count("*").alias("distinct_count")).select(F.lit(name).alias("platform"), "distinct_count")
    return one(source, "source").union(one(target, "target"))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, null_count, null_rate (4 places), from one pass over the table."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns))
    rate = F.round(F.col("c.null_count") / F.greatest("_n", F.lit(1)), 4)
    return counts.select("_n", F.explode(rows).alias("c")).select("c.column_name", "c.null_count", rate.alias("null_rate"))


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: row_count and a sum of row hashes that doesn't depend on order."""
    return df.agg(F.count("*").alias("row_count"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("checksum"))


def sample_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], limit: int = 100) -> DataFrame:
    """The first keys, in order, that one side lacks, with the side that has them. Null is a key like others."""
    keys = list(keys)
    only = lambda a, b, side: without(a.select(*keys), b, keys).withColumn("only_in", F.lit(side))
    return only(source, target, "source").union(only(target, source, "target")).orderBy(*keys, "only_in").limit(limit)


def value_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The keys, n_source, n_target and changed (names, comma-joined) where the two sides differ; keys are unique a side.

    A full outer join by the keys, null a key like others: rows that one side lacks have 0 there and no changed names.
    """
    side = lambda df, name: df.select(*(F.col(k).alias(f"_{name}_{k}") for k in keys), *(F.col(c).alias(f"_{name}_value_{c}") for c in columns), F.lit(1).alias(f"_{name}"))
    same = reduce(lambda a, b: a & b, (F.col(f"_s_{k}").eqNullSafe(F.col(f"_t_{k}")) for k in keys))
    both = side(source, "s").join(side(target, "t"), same, "full")
    present = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    changed = F.array_join(F.array_compact(F.array(*(F.when(present & ~F.col(f"_s_value_{c}").eqNullSafe(F.col(f"_t_value_{c}")), F.lit(c)) for c in columns))), ",")
    named = both.select(*(F.coalesce(f"_s_{k}", f"_t_{k}").alias(k) for k in keys), F.coalesce("_s", F.lit(0)).alias("n_source"), F.coalesce("_t", F.lit(0)).alias("n_target"), changed.alias("changed"))
    return named.where("n_source <> n_target OR changed <> ''")


def metric_tolerance(source: DataFrame, target: DataFrame, metrics: dict[str, F.Column], tolerance: float = 0.01) -> DataFrame:
    """metric, source_value, target_value, passed: whether the relative difference is within the tolerance."""
    def values(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))
        return df.agg(*(c.alias(m) for m, c in metrics.items())).select(F.explode(pairs).alias("p")).select("p.metric", f"p.{name}")

    both = values(source, "source_value").join(values(target, "target_value"), "metric")
    apart = F.abs(F.col("source_value") - F.col("target_value"))
    return both.withColumn("passed", apart <= tolerance * F.greatest(F.abs("source_value"), F.lit(1e-12)))


def report(results: Sequence[DataFrame]) -> DataFrame:
    """Several results of row_counts, distinct_counts or the like as one table of strings."""
    as_text = lambda df: df.select(F.to_json(F.struct("*")).alias("result"))
    return reduce(DataFrame.union, map(as_text, results))
