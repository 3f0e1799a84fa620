"""Connected components and the search for all links within buckets, without pairs of a whole bucket."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryflow.llm.common import keep, tidy

#: Pairs that are tested at once within two blocks.
PAIRS = 1 << 15


@tidy
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node that can be reached.

    Each round hangs every node under its smallest neighbour, follows those links to their ends by doubling, and
    rewrites the edges between the ends; edges within one tree vanish. Tables are kept from round to round, only
    counts reach the driver, and no step gathers a component.
    """
    edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        up = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = keep(up.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "links")
        while True:
            ends = links.where("node <> root").select(F.col("node").alias("_at"), F.col("root").alias("_next"))
            longer = links.join(ends, F.col("root") == F.col("_at"), "left")
            links = keep(longer.select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "links")
            if links.where("moved").isEmpty():
                break
        before = roots
        if roots is None:
            roots = keep(links.select("node", "root"), "roots")
        else:
            ends = links.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
            roots = keep(before.join(ends, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_next", "root").alias("root")), "roots")
        one = links.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        two = links.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        edges = keep(edges.join(one, "a").join(two, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    return roots if roots is not None else keep(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")


@tidy
def extended(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """roots, as components() gives them, with further links (a, b): only what the links join is worked out anew."""
    if roots is None:
        return components(links)
    ends = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    mapped = links.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
    more = components(mapped.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    old = roots.join(more.select(F.col("node").alias("_at"), F.col("root").alias("_next")), F.col("root") == F.col("_at"), "left")
    new = more.join(roots.select("node"), "node", "left_anti")
    return keep(old.select("node", F.coalesce("_next", "root").alias("root")).union(new.select("node", "root")), "roots")


def tasks(df: DataFrame) -> int:
    """How many tasks costly rows are dealt to. Spark would join parts by their bytes, however long their rows take."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_contents(pairs: DataFrame, content: DataFrame, fan: int = 64, spread: bool = False) -> DataFrame:
    """pairs (a, b) with content_a and content_b, from content (node, content).

    One node can be in very many pairs. Its pairs are dealt to one part for each fan of them, and its content is
    repeated for each part, so no task gets all pairs of a node. spread: the pairs are dealt to all tasks, since what
    is done with each takes long.
    """
    parts = keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / fan).cast("int").alias("_parts")), "parts")
    dealt = pairs.join(parts, "a").withColumn("_part", F.pmod(F.xxhash64("b"), "_parts").cast("int")).drop("_parts")
    of = lambda c: content.select(F.col("node").alias(c), F.col("content").alias(f"content_{c}"))  # noqa: E731 - alike, so contents are dealt once
    one = of("a").join(parts, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "content_a")
    two = of("b")
    held = dealt.join(two, "b")
    held = held.repartition(tasks(pairs), "a", "_part") if spread else held
    return held.join(one, ["a", "_part"]).select("a", "b", "content_a", "content_b")


def crowds(members: DataFrame) -> DataFrame:
    """The members (bucket, node, size) of buckets with several nodes, with the bucket's count n; kept.

    The members, most of which are alone, are dealt once; a window that is larger than Spark's buffer goes to disk.
    """
    n = F.count("*").over(Window.partitionBy("bucket"))
    return keep(members.select("bucket", "node", "size").withColumn("n", n).where("n > 1"), "crowds")


@tidy
def linked_within_buckets(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[str, str], Column] | None = None, dense: Dense | None = None) -> DataFrame:
    """(node, root) of the components that verified links between members of common buckets make.

    shared: (bucket, node, size, n), kept, as crowds() gives. verify: takes pairs (a, b) and returns those that are
    links. fits: a cheap necessary condition on the columns of two sizes.

    First each member of a bucket is compared with the smallest one, then with one chosen by hash; most groups are
    whole by then. At last, in buckets that still hold several components, the members outside the bucket's most
    frequent component are compared with all members of other components. So every pair that shares a bucket is
    either compared or already connected. With dense, large buckets of that kind are compared by blocks. Buckets of two
    have been compared in whole by the first step.
    """
    fits = fits or (lambda a, b: F.lit(True))
    tested = []

    def grown(roots: DataFrame | None, pairs: DataFrame, more: DataFrame | None = None) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        tested.append(pairs)
        found = verify(pairs).select("a", "b")
        return extended(roots, keep(found.union(more) if more is not None else found, "links"))

    pivots = shared.groupBy("bucket").agg(F.min("node").alias("pivot"), F.min_by("size", "node").alias("pivot_size"))
    first = shared.join(pivots, "bucket").where("node <> pivot").where(fits("size", "pivot_size"))
    roots = grown(None, first.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    shared = shared.where("n > 2")

    for full in (False, True):
        named = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_root = named.groupBy("bucket", "root").agg(F.count("*").alias("_n"), F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node", "size")).alias("_pick"))
        mixed = by_root.groupBy("bucket").agg(F.count("*").alias("_roots"), F.max(F.struct("_n", "root", "_pick")).alias("_most")).where("_roots > 1")
        mixed = mixed.select("bucket", F.col("_most.root").alias("_main"), F.col("_most._pick.node").alias("_pivot"), F.col("_most._pick.size").alias("_size"))
        open_ones = keep(named.join(mixed, "bucket"), "open")
        if open_ones.isEmpty():
            break
        shared = open_ones.select("bucket", "node", "size", "n")  # a bucket of one root stays so
        if full:
            large = None
            if dense is not None:
                crowded = open_ones.where(F.col("n") > dense.least)
                large = None if crowded.isEmpty() else linked_in_blocks(crowded, dense)
                open_ones = open_ones.where(F.col("n") <= dense.least)
            others = open_ones.select("bucket", F.col("node").alias("_node"), F.col("size").alias("_other"), F.col("root").alias("_root"))
            pairs = open_ones.where("root <> _main").join(others, "bucket").where((F.col("root") != F.col("_root")) & ((F.col("_root") == F.col("_main")) | (F.col("node") < F.col("_node"))))
            pairs = pairs.where(fits("size", "_other")).select(F.col("node").alias("a"), F.col("_node").alias("b"))
            roots = grown(roots, pairs, large)
        else:
            pairs = open_ones.where("root <> _main").where(fits("size", "_size")).select(F.col("node").alias("a"), F.col("_pivot").alias("b"))
            roots = grown(roots, pairs)
    return roots


@dataclass
class Dense:
    """How to compare the members of large buckets: content (node, content), and a test of two prepared contents.

    merge: buckets that share members are compared as one. Contents then travel once, but members that share no bucket
    meet as well; where contents are small, each bucket by itself is less work.
    """

    content: DataFrame
    prepare: Callable
    linked: Callable
    least: int = 16
    block: int = 128
    part: int = 1024
    merge: bool = True
    #: Takes two lists of prepared contents and returns which pairs may be linked, as one matrix of booleans.
    sieve: Callable | None = None
    #: Takes these lists and the places of pairs in the one and the other, and tests all the pairs at once.
    linked_many: Callable | None = None


def linked_in_blocks(members: DataFrame, dense: Dense) -> DataFrame:
    """Links (a, b) among members (bucket, node, root, _pivot) of buckets that overlap, between different roots.

    _pivot is one member of the bucket. Buckets that share members form a cluster. Its members lie in blocks; those outside its most frequent root are
    sent to every block, in parts, and compared there with all members of other roots. A task holds one block and one
    part, whatever the cluster's size, and no row is made for a pair that isn't a link. A pair of members that share
    several buckets is compared in the first of them only.
    """
    if dense.merge:
        clusters = components(members.select(F.col("node").alias("a"), F.col("_pivot").alias("b")))
        nodes = members.select("node", "root").distinct().join(clusters.withColumnRenamed("root", "cluster"), "node").withColumn("before", F.array().cast("array<long>"))
    else:
        of = members.groupBy("node").agg(F.collect_list("bucket").alias("_all"))
        nodes = members.join(of, "node").select("node", "root", F.col("bucket").alias("cluster"), F.filter("_all", lambda b: b < F.col("bucket")).alias("before"))
    nodes = keep(nodes.join(dense.content, "node"), "dense")
    by_root = nodes.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    totals = by_root.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    shape = totals.select(
        "cluster",
        F.col("most.root").alias("main"),
        F.ceil(F.col("n") / dense.block).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("most.n")) / dense.part)).cast("int").alias("parts"),
    )
    nodes = nodes.join(shape, "cluster").withColumn("rest", F.col("root") != F.col("main"))
    deal = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    columns = ["cluster", "block", "part", "node", "root", "rest", "before", "content"]
    held = nodes.withColumn("block", deal("blocks")).withColumn("part", each("parts")).select(*columns)
    asks = nodes.where("rest").withColumn("part", deal("parts")).withColumn("block", each("blocks")).select(*columns).toDF(*columns)  # columns of its own
    prepare, linked, sieve, linked_many = dense.prepare, dense.linked, dense.sieve, dense.linked_many

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(one) and len(two):
            asked, theirs = list(map(prepare, one["content"])), list(map(prepare, two["content"]))
            a, b = one["node"].to_numpy(), two["node"].to_numpy()
            roots, rest = two["root"].to_numpy(), two["rest"].to_numpy(bool)
            may = (one["root"].to_numpy()[:, None] != roots[None, :]) & ~(rest[None, :] & (b[None, :] < a[:, None]))
            met: dict[int, tuple[list, list]] = {}
            for side, frame in enumerate((one, two)):
                for i, buckets in enumerate(frame["before"]):
                    for bucket in buckets:
                        met.setdefault(bucket, ([], []))[side].append(i)
            for some, others in met.values():
                may[np.ix_(some, others)] = False
            if sieve is not None:
                may &= sieve(asked, theirs)
            if linked_many is not None:
                i, j = np.nonzero(may)
                for at in range(0, len(i), PAIRS):
                    some, others = i[at : at + PAIRS], j[at : at + PAIRS]
                    new = may[some, others]  # not those whose link to a root has been found
                    some, others = some[new], others[new]
                    found = linked_many(asked, theirs, some, others)
                    for x, y in zip(some[found].tolist(), others[found].tolist(), strict=True):
                        if may[x, y]:  # one link to a root is enough
                            may[x, roots == roots[y]] = False
                            rows.append((a[x], b[y]))
                return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                near = set()  # one link to a root is enough
                for j in np.flatnonzero(may[i]).tolist():
                    if roots[j] not in near and linked(asked[i], theirs[j]):
                        near.add(roots[j])
                        rows.append((a[i], b[j]))
        return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    key = ["cluster", "block", "part"]
    if linked_many is not None:
        asks, held = asks.repartition(tasks(members), *key), held.repartition(tasks(members), *key)
    return asks.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(compare, "a long, b long")
