"""Sketches that merge: distinct counts (HLL) and quantiles (KLL), made once at a fine grain and rolled up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of an HLL sketch as a power of two: a standard error of 1.04 / sqrt(2 ** LOG_K), 1.6 %.
LOG_K = 12
#: Size of a KLL sketch: ranks are within about 0.7 % in 99 of 100 cases.
KLL_K = 400


def make(df: DataFrame, by: Sequence[str], distinct: str, measure: str) -> DataFrame:
    """by, rows, hll, kll: one sketch of each kind a group; nulls are left out of both."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(distinct, LOG_K).alias("hll"), F.kll_sketch_agg_double(F.col(measure).cast("double"), KLL_K).alias("kll"))


def roll_up(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("hll", F.lit(True)).alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))


def estimates(sketches: DataFrame, by: Sequence[str], ranks: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """by, rows, distinct, and q50, q90, ... for the ranks asked for."""
    held = F.kll_sketch_get_n_double("kll") > 0  # an empty sketch has no quantiles
    quantiles = [F.when(held, F.kll_sketch_get_quantile_double("kll", F.lit(float(r)))).alias(f"q{round(100 * r)}") for r in ranks]
    return sketches.select(*by, "rows", F.hll_sketch_estimate("hll").alias("distinct"), *quantiles)
