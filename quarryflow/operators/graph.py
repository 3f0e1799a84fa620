"""Lineage as an edge table (src, dst): degrees, neighbours, bounded reachability, cycles, orphans.

Everything is joins over edges; frontiers are kept distinct, so a dense graph costs nodes times depth, not paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryflow.sources.scratch import fresh_folder


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.countDistinct("dst").alias("n"))


def neighbours(edges: DataFrame) -> DataFrame:
    """node, upstream, downstream: sorted, comma-joined names."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    up = edges.groupBy(F.col("dst").alias("node")).agg(names("src").alias("upstream"))
    down = edges.groupBy(F.col("src").alias("node")).agg(names("dst").alias("downstream"))
    return up.join(down, "node", "full").select("node", F.coalesce("upstream", F.lit("")).alias("upstream"), F.coalesce("downstream", F.lit("")).alias("downstream"))


def neighbour_rows(edges: DataFrame) -> DataFrame:
    """node, direction, neighbour: one row each, so a hub's neighbours are rows like others."""
    down = edges.select(F.col("src").alias("node"), F.lit("downstream").alias("direction"), F.col("dst").alias("neighbour"))
    up = edges.select(F.col("dst").alias("node"), F.lit("upstream").alias("direction"), F.col("src").alias("neighbour"))
    return down.union(up).where("node IS NOT NULL").distinct()


def cut(df: DataFrame) -> DataFrame:
    """df from files in the shared folder of spark.checkpoint.dir, so later steps don't repeat it.

    A checkpoint would compute df twice, once to count it and once to write it, and read back whole rows of Java objects.
    """
    folder = fresh_folder(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """_src, _dst: distinct steps downstream, upstream or both ways."""
    down = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    up = down.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst"))
    return {"downstream": down, "upstream": up, "both": down.union(up)}[direction].distinct()


def reachability(edges: DataFrame, starts: DataFrame, depth: int = 10, direction: str = "downstream") -> DataFrame:
    """start, node, distance: nodes reached from each start within depth steps, by the fewest steps.

    One join a step; what has been reached before leaves the frontier, and the walk ends when nothing is new. depth is
    the caller's limit: nodes farther away are not in the result.
    """
    steps = directed(edges, direction)
    frontier = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("distance", F.lit(0))
    found = frontier
    for k in range(1, depth + 1):
        reached = frontier.join(steps, F.col("node") == F.col("_src")).select("start", F.col("_dst").alias("node")).distinct()
        frontier = cut(reached.join(found, ["start", "node"], "left_anti").withColumn("distance", F.lit(k)))
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    return found


def on_cycles(edges: DataFrame, depth: int = 10) -> DataFrame:
    """node, length: nodes on a cycle of at most depth steps, with the shortest one's length.

    Edges that no cycle can have, for want of a way in or out, are taken off first, until none is left; walks go over the
    rest only, never twice to the same node. depth is the caller's limit: nodes on longer cycles are not in the result.
    """
    steps = cut(directed(edges, "downstream"))
    while True:
        n = steps.count()
        into, out = steps.select(F.col("_dst").alias("_src")).distinct(), steps.select(F.col("_src").alias("_dst")).distinct()
        steps = cut(steps.join(into, "_src", "left_semi").join(out, "_dst", "left_semi").select("_src", "_dst"))
        if steps.count() == n:
            break
    walk = steps.select(F.col("_src").alias("start"), F.col("_dst").alias("node")).withColumn("length", F.lit(1))
    found = walk
    for k in range(2, depth + 1):
        longer = walk.join(steps, F.col("node") == F.col("_src")).select("start", F.col("_dst").alias("node")).distinct()
        walk = cut(longer.join(found, ["start", "node"], "left_anti").withColumn("length", F.lit(k)))
        if walk.isEmpty():
            break
        found = found.union(walk)
    return found.where("start = node").select("node", "length")


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that nothing reads: without an edge going out."""
    return nodes.select("node").distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")
