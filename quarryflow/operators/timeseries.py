"""Time slices of each partition with constant and linear interpolation, as TIMESERIES does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryflow.operators.patterns import cell, micros

#: Slices that are filled in by one array.
RUN = 4096


def slices(rows: DataFrame, partition: Sequence[str], order: str, ties: Sequence[str], value: str, seconds: float) -> DataFrame:
    """One row a slice from the first to the last one of each partition: the partition's columns, slice_us (its first
    microsecond since 1970), n (values in it), and first_const, first_linear, last_const, last_linear.

    In a slice with values, first and last are its first and last value. In one without, const is the last value before
    it, and linear lies on the line from that to the first value after it, at the slice's begin (first) or end (last).
    Null values and rows without a time are left out; null partitions are one partition; ties order equal times.

    Values are gathered by slice before anything is sorted, and each slice fills in those up to the next: neither the
    rows of a partition nor a calendar meet in one place.
    """
    width = max(1, round(seconds * 1_000_000))
    good = rows.where(F.col(order).isNotNull() & F.col(value).isNotNull())
    points = good.select(F.struct(*partition).alias("_p"), F.struct(micros(good, order).alias("us"), *(F.col(t).alias(f"t{k}") for k, t in enumerate(ties)), F.col(value).cast("double").alias("v")).alias("x"))
    held = points.groupBy("_p", cell(F.col("x.us"), width).alias("k")).agg(F.min("x").alias("one"), F.max("x").alias("two"), F.count("*").alias("n"))
    after = Window.partitionBy("_p").orderBy("k")
    held = held.withColumn("to", F.lead(F.struct("k", "one")).over(after))
    stop = F.coalesce(F.col("to.k") - 1, F.col("k"))
    names = {"one": "one.v", "two": "two.v", "two_us": "two.us", "to": "to.one.v", "to_us": "to.one.us"}
    held = held.select("_p", "k", "n", stop.alias("stop"), *(F.col(c).alias(f"_{name}") for name, c in names.items()))
    runs = held.withColumn("_from", F.explode(F.sequence("k", "stop", F.lit(RUN))))
    each = runs.withColumn("_k", F.explode(F.sequence("_from", F.least("stop", F.col("_from") + RUN - 1))))
    own, start = F.col("_k") == F.col("k"), F.col("_k") * width

    def line(at):
        share = (at - F.col("_two_us")).cast("double") / (F.col("_to_us") - F.col("_two_us")).cast("double")
        return F.col("_two") + (F.col("_to") - F.col("_two")) * share

    found = {
        "slice_us": start, "n": F.when(own, F.col("n")).otherwise(0).cast("long"),
        "first_const": F.when(own, F.col("_one")).otherwise(F.col("_two")), "first_linear": F.when(own, F.col("_one")).otherwise(line(start)),
        "last_const": F.col("_two"), "last_linear": F.when(own, F.col("_two")).otherwise(line(start + width)),
    }
    return each.select("_p.*", *(c.alias(name) for name, c in found.items()))
