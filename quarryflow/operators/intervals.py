"""Joins of ranges that overlap, by bins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryflow.operators.patterns import cell


def interval_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: int, on: Sequence[str] = (), parts: int = 1) -> DataFrame:
    """l, r (structs of all columns): the pairs whose ranges [from, to] of whole numbers overlap, with equal columns on.

    Each range goes to every bin of width that it reaches, pairs meet within a bin, and a pair in several bins counts in
    the one where the later of both begins; the exact test follows. So the join has equal keys and never compares all
    with all. width: about the length of the longer ranges. parts: left's rows of one bin are dealt to so many parts,
    right's repeated for each, for bins that hold too much. Ranges with a null end or that end before they begin, and
    null keys, meet nothing.
    """

    def binned(df: DataFrame, ends: tuple[str, str], name: str) -> DataFrame:
        a, b = (F.col(c).cast("long") for c in ends)
        df = df.select(F.struct(*df.columns).alias(name), a.alias(f"_{name}_from"), b.alias(f"_{name}_to"), *(F.col(c).alias(f"_{name}_{c}") for c in on))
        df = df.where(F.col(f"_{name}_from") <= F.col(f"_{name}_to"))
        return df.withColumn(f"_{name}_bin", F.explode(F.sequence(cell(F.col(f"_{name}_from"), width), cell(F.col(f"_{name}_to"), width))))

    one, two = binned(left, left_range, "l"), binned(right, right_range, "r")
    one = one.withColumn("_l_part", F.pmod(F.xxhash64("l"), F.lit(parts)).cast("int"))
    two = two.withColumn("_r_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    equal = [F.col(f"_l_{c}") == F.col(f"_r_{c}") for c in ("bin", "part", *on)]
    both = one.join(two, equal)
    begins = cell(F.greatest("_l_from", "_r_from"), width)
    return both.where((F.col("_l_from") <= F.col("_r_to")) & (F.col("_r_from") <= F.col("_l_to")) & (F.col("_l_bin") == begins)).select("l", "r")


def points_within(centres: DataFrame, points: DataFrame, reach: int, width: int, parts: int = 1) -> DataFrame:
    """id, n, nearest, first: for each centre the points at most reach away: how many, the least distance, the least id.

    Both have (id, at), whole numbers; several rows of a centre's id count together, centres without points are left out,
    rows without at meet nothing and points without id count, but are never first. Pairs are not made: a cell of width
    holds its centres and, in order, the points that any of them can reach, where two searches give a centre's range.
    A task holds the points of 2 * reach + width at once. parts: a cell's centres are dealt to so many parts.
    """
    cells = lambda a, b: F.explode(F.sequence(cell(a, width), cell(b, width)))
    at = F.col("at").cast("long")
    one = centres.where("at IS NOT NULL").select(F.col("id").cast("long").alias("id"), at.alias("at"), cell(at, width).alias("_cell"), F.pmod(F.xxhash64("id", "at"), F.lit(parts)).cast("int").alias("_part"))
    two = points.where("at IS NOT NULL").select(F.col("id").cast("long").alias("id"), at.alias("at"), cells(at - reach, at + reach).alias("_cell"))
    two = two.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def ranged(left: pa.Table, right: pa.Table) -> pa.Table:
        at, order = left.column("at").to_numpy(), np.argsort(right.column("at").to_numpy(), kind="stable")
        where, none = right.column("at").to_numpy()[order], np.iinfo(np.int64).max
        named = right.column("id").is_valid().to_numpy()[order]
        ids = np.where(named, right.column("id").fill_null(0).to_numpy()[order], none)
        begin, end = np.searchsorted(where, at - reach, "left"), np.searchsorted(where, at + reach, "right")
        held = end > begin
        at, begin, end = at[held], begin[held], end[held]
        after = np.searchsorted(where, at)
        nearest = np.full(len(at), none)
        for place in (after - 1, after):
            inside = (place >= begin) & (place < end)
            nearest[inside] = np.minimum(nearest[inside], np.abs(where[place[inside]] - at[inside]))
        # least ids of runs of 1, 2, 4, ... points; two runs cover a range
        first, known, size, level = np.full(len(at), none), np.zeros(len(at), bool), 1, (ids, named)
        runs = np.frexp((end - begin).astype(np.float64))[1] - 1
        for k in range(int(runs.max(initial=-1)) + 1):
            of = runs == k
            a, b = begin[of], end[of] - size
            first[of], known[of] = np.minimum(level[0][a], level[0][b]), level[1][a] | level[1][b]
            level = np.minimum(level[0][:-size], level[0][size:]), level[1][:-size] | level[1][size:]
            size *= 2
        own = left.column("id").filter(pa.array(held))
        return pa.table({"id": own, "n": pa.array(end - begin, pa.int64()), "nearest": pa.array(nearest, pa.int64()), "first": pa.array(first, pa.int64(), mask=~known)})

    met = one.groupBy("_cell", "_part").cogroup(two.groupBy("_cell", "_part")).applyInArrow(ranged, "id long, n long, nearest long, first long")
    return met.groupBy("id").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"), F.min("first").alias("first"))
