"""Elementary cycles of a directed graph: strongly connected parts first, then simple paths within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryflow.operators.graph import cut, directed

#: Rounds that take off nodes without a way in or out before parts are looked for; the walks take care of the rest.
TRIMS = 3
#: Walks from one node up to which parts aren't looked for: following all walks then costs less than the rounds of that.
WALKS = 64


def _trimmed(steps: DataFrame) -> DataFrame:
    into, out = steps.select(F.col("_dst").alias("_src")).distinct(), steps.select(F.col("_src").alias("_dst")).distinct()
    return steps.join(into, "_src", "left_semi").join(out, "_dst", "left_semi").select("_src", "_dst")


def _spread(values: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, least): the least value of all nodes with a way to each node. values: (node, least). One join a round."""
    fresh = values
    while True:
        sent = fresh.join(steps, F.col("node") == F.col("_src")).groupBy(F.col("_dst").alias("node")).agg(F.min("least").alias("_sent"))
        merged = cut(values.join(sent, "node", "left").select("node", F.least("least", "_sent").alias("least"), (F.col("_sent") < F.col("least")).alias("_new")))
        values, fresh = merged.select("node", "least"), merged.where("_new").select("node", "least")
        if fresh.isEmpty():
            return values


def strong_parts(edges: DataFrame) -> DataFrame:
    """node, part: the strongly connected part of each node that lies on a cycle of several nodes; part is a node of it.

    Every node takes the least node with a way to it as its colour; what can walk back from a colour's own node within
    the colour is one part. Parts are taken off and the rest coloured anew, until nothing is left.
    """
    steps = cut(directed(edges.where("src <> dst"), "downstream"))
    found = None
    while True:
        for _ in range(TRIMS):
            steps = _trimmed(steps)
        steps = cut(steps)
        if steps.isEmpty():
            break
        nodes = steps.select(F.col("_src").alias("node")).distinct()
        colours = _spread(nodes.select("node", F.col("node").alias("least")), steps)
        of = lambda c: colours.select(F.col("node").alias(c), F.col("least").alias(f"{c}_colour"))
        within = cut(steps.join(of("_src"), "_src").join(of("_dst"), "_dst").where("_src_colour = _dst_colour").select("_src", "_dst", F.col("_src_colour").alias("colour")))
        back = within.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst"))
        part = front = cut(colours.where("node = least").select("node", F.col("least").alias("part")))
        while True:
            reached = front.join(back, F.col("node") == F.col("_src")).select(F.col("_dst").alias("node"), "part").distinct()
            front = cut(reached.join(part, "node", "left_anti"))
            if front.isEmpty():
                break
            part = part.union(front)
        part = cut(part)
        found = part if found is None else found.union(part)
        gone = part.select("node")
        steps = cut(steps.join(gone.toDF("_src"), "_src", "left_anti").join(gone.toDF("_dst"), "_dst", "left_anti").select("_src", "_dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("part")).limit(0)
    several = found.groupBy("part").agg(F.count("*").alias("n")).where("n > 1")
    return cut(found.join(several, "part", "left_semi").select("node", "part"))


def elementary_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """cycle (array of nodes, the least first), length: every cycle of at most longest edges without a repeated node, once.

    edges: (src, dst); repeated edges count once, an edge from a node to itself is a cycle of one, edges with a null end
    are none. A graph can have exponentially many cycles, so longest is the caller's limit. Walks begin at their least
    node. Where the out-degrees allow more than WALKS walks from a node, they stay within its strongly connected part.
    """
    edges = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    several = edges.where("src <> dst")
    most = several.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    if few_walks(most, longest):
        steps = _trimmed(several.toDF("_src", "_dst")).toDF("_at", "_to")
    else:
        parts = strong_parts(edges)
        of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"_{c}"))
        steps = several.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select(F.col("src").alias("_at"), F.col("dst").alias("_to"))
    steps = cut(steps)
    found = edges.where("src = dst").select(F.array("src").alias("cycle"))
    walk = steps.where("_to > _at").select(F.array("_at", "_to").alias("cycle"))
    first, at = F.col("cycle")[0], F.element_at("cycle", -1) == F.col("_at")
    for length in range(2, longest + 1):
        if length == longest or walk.isEmpty():
            found = found.union(walk.join(steps, at & (first == F.col("_to"))).select("cycle"))
            break
        on = walk.join(steps, at).where((F.col("_to") == first) | ((F.col("_to") > first) & ~F.array_contains("cycle", F.col("_to"))))
        on = cut(on.select((F.col("_to") == first).alias("closed"), F.when(F.col("_to") == first, F.col("cycle")).otherwise(F.concat("cycle", F.array("_to"))).alias("cycle")))
        found = found.union(on.where("closed").select("cycle"))
        walk = on.where("NOT closed").select("cycle")
    return found.select("cycle", F.size("cycle").cast("long").alias("length"))


def few_walks(degree: int, longest: int) -> bool:
    """Whether out-degrees of at most so many allow at most WALKS walks of longest - 1 steps from a node."""
    return degree <= 1 or longest <= 2 or (degree <= WALKS and degree ** min(longest - 1, 64) <= WALKS)
