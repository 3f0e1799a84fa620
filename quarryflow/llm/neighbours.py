"""Approximate nearest neighbours by adaptive dimension scan (operator 9).

Vectors are grouped into lists around centroids that k-means finds on a bounded sample; every vector is indexed. A
query first probes the FIRST lists with the nearest centroids, which gives it a distance that its k-th neighbour cannot
be beyond. With that bound it probes the further lists that pass a test: for a member at distance r of a centroid at
distance D, in a random direction, the squared distance is D^2 + r^2 with a spread of 2 D r / sqrt(dimensions); a list
is left out if no member is within the bound even LISTS_WIDTH spreads below that. Vectors in clusters have their
neighbours in a few lists, vectors without any in most, and the test finds out which.

Within a list, vectors are rotated at random, so the first columns are a random projection, and are compared a block of
columns at a time: after each block a hypothesis test asks whether the partial distance, scaled up, can still belong to
a distance within the bound, and drops what can't.

Equal vectors are one class. Of a class only its k + 1 smallest ids can be among the k nearest of anything (ties go to
smaller ids), so a class carries those, and equal queries are searched once. Long lists are split into parts, and so are
the queries that ask one list.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, nor do rows with a null vec_id; repeated rows are candidates of each other; with k candidates or fewer
all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryflow.llm.common import keep, tidy

#: Rows that k-means is fitted on, at most.
SAMPLE_ROWS = 32_768
LISTS = 16_384
#: Lists that every query probes, and the width of the test that chooses further ones: larger leaves out fewer.
FIRST, LISTS_WIDTH = 8, 2.4
#: Vectors in one part of a list, on average at most, and queries that meet them in one task.
PART, ASKS = 2048, 1024
BLOCK = 16
#: The width of the test within lists: larger drops fewer true neighbours.
WIDTH = 2.3


def usable(vector: str) -> Column:
    """Not null, not zero, all components present and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """Lloyd's rounds from random distinct rows; a centroid without rows stays."""
    x = np.unique(x, axis=0)
    centroids = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centroids))
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, chunk: int = 1024) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + chunk] @ centroids.T - half, axis=1) for i in range(0, len(x), chunk)] or [np.zeros(0, int)])


def rotation(dims: int, seed: int = 9) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]


def scan_all(queries: np.ndarray, rotated: np.ndarray, bounds: np.ndarray, k: int, chunk: int = 512, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of rotated queries and rows, nearly surely with each query's k nearest within its bound.

    bounds: squared distances that the k nearest are known not to exceed, infinite where nothing is known. They become
    smaller as rows are found.
    """
    dims, found = rotated.shape[1], []
    for start in range(0, len(queries), batch):
        q, limit = queries[start : start + batch], bounds[start : start + batch].copy()
        best_q, best_row, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = 0
        while at < len(rotated):
            rows = rotated[at : at + (chunk if np.isfinite(limit).all() else 64)]
            of_q, of_row = np.divmod(np.arange(len(q) * len(rows)), len(rows))
            partial = np.zeros(len(of_q))
            for column in range(0, dims, BLOCK):
                stop = min(dims, column + BLOCK)
                if column == 0:  # every pair is alive: one product of matrices
                    x, y = q[:, :stop], rows[:, :stop]
                    partial = np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0).ravel()
                else:
                    partial = partial + ((rows[of_row, column:stop] - q[of_q, column:stop]) ** 2).sum(1)
                slack = (1 + WIDTH / math.sqrt(stop)) ** 2 * stop / dims if stop < dims else 1
                alive = partial <= limit[of_q] * slack + 1e-9
                of_q, of_row, partial = of_q[alive], of_row[alive], partial[alive]
            best_q, best_row, best = np.concatenate((best_q, of_q)), np.concatenate((best_row, of_row + at)), np.concatenate((best, partial))
            order = np.lexsort((best, best_q))
            best_q, best_row, best = best_q[order], best_row[order], best[order]
            turn = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            limit[best_q[turn == k - 1]] = np.minimum(limit[best_q[turn == k - 1]], best[turn == k - 1])
            stays = best <= limit[best_q] + 1e-9  # ties and rounding stay; exact distances decide
            best_q, best_row, best = best_q[stays], best_row[stays], best[stays]
            at += len(rows)
        found.append((best_q + start, best_row))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def scan(query: np.ndarray, rotated: np.ndarray, k: int) -> np.ndarray:
    """Rows of rotated that may be among the k nearest of one rotated query, nearly surely with all of those."""
    return scan_all(query[None, :], rotated, np.array([math.inf]), k)[1]


@tidy
def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other rows; kept."""
    spark = table.sparkSession
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"), F.monotonically_increasing_id().alias("row"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable("v"))
    rows = keep(rows.withColumn("same", F.md5(F.array_join("v", ",").cast("binary"))), "vectors")
    usual = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").head()
    if usual is None:
        return keep(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), "answers")
    dims = usual["dims"]
    rows = rows.where(F.size("v") == dims)

    in_class = Window.partitionBy("same").orderBy("vec_id", "row")
    few = rows.withColumn("_n", F.row_number().over(in_class)).where(F.col("_n") <= k + 1)
    classes = few.groupBy("same").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("c"), F.min_by("v", "_n").alias("v"))
    classes = classes.select("same", F.col("c.vec_id").alias("ids"), F.col("c.row").alias("rows"), "v")

    sample = rows.groupBy("same").agg(F.min_by("v", "row").alias("v")).orderBy(F.xxhash64("same"), "same").limit(SAMPLE_ROWS).select("v").toPandas()
    distinct = rows.select("same").distinct().count()
    centroids = k_means(np.array(sample["v"].tolist(), float), max(1, min(LISTS, round(math.sqrt(distinct)))))
    turn = rotation(dims)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["v"].tolist(), float).reshape(len(frame), dims)
            near = nearest(x, centroids)
            yield frame.assign(list=near.astype(np.int32), radius=np.sqrt(((x - centroids[near]) ** 2).sum(1)))

    indexed = keep(classes.mapInPandas(assign, "same string, ids array<long>, rows array<long>, v array<double>, list int, radius double"), "index")
    counts, least, most = np.zeros(len(centroids), np.int64), np.full(len(centroids), math.inf), np.zeros(len(centroids))
    for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.min("radius").alias("a"), F.max("radius").alias("b")).collect():  # one row a list, LISTS at most
        counts[r["list"]], least[r["list"]], most[r["list"]] = r["n"], r["a"], r["b"]
    parts = np.maximum(1, -(-counts // PART))
    asked = keep(rows.where("asks").groupBy("same").agg(F.min_by("v", "row").alias("v")), "asked")

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The lists that each query asks: the first ones, or, where it has a bound, the others that pass the test."""
        for frame in frames:
            q = np.array(frame["v"].tolist(), float).reshape(len(frame), dims)
            for at in range(0, len(q), 256):
                away = np.sqrt(np.maximum(((q[at : at + 256] ** 2).sum(1))[:, None] + (centroids**2).sum(1)[None, :] - 2 * q[at : at + 256] @ centroids.T, 0))
                order = np.argsort(away, axis=1, kind="stable")
                enough = np.maximum(FIRST, (np.cumsum(counts[order], axis=1) < 10 * (k + 1)).sum(1) + 1)
                for i in range(len(away)):
                    row = frame.iloc[at + i]
                    first, bound = order[i, : enough[i]], row["bound"] if "bound" in frame else None
                    chosen = first
                    if bound is not None:
                        spread = LISTS_WIDTH / math.sqrt(dims) * away[i]
                        r = np.clip(spread, np.minimum(least, most), most)
                        chosen = np.setdiff1d(np.flatnonzero((away[i] ** 2 + r**2 - 2 * spread * r <= bound) & (counts > 0)), first)
                    if not len(chosen):
                        continue
                    lists = np.repeat(chosen, parts[chosen])
                    part = np.concatenate([np.arange(p) for p in parts[chosen]])
                    yield pd.DataFrame({"asked": row["same"], "v": [row["v"]] * len(lists), "list": lists.astype(np.int32), "part": part.astype(np.int32), "bound": math.inf if bound is None else bound})

    by_list = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(parts), dtype=np.int32), "parts": parts}))
    members = indexed.join(F.broadcast(by_list), "list").withColumn("part", F.pmod(F.xxhash64("same"), "parts").cast("int")).drop("parts", "radius")  # LISTS rows at most

    def compare(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asks) and len(held):
            own, query = (np.array(x["v"].tolist(), float).reshape(len(x), dims) for x in (held, asks))
            smallest = np.array([ids[0] for ids in held["ids"]])
            of_q, of_row = scan_all(query @ turn, own @ turn, asks["bound"].to_numpy(), k + 1)
            score = np.sqrt(((own[of_row] - query[of_q]) ** 2).sum(1))
            order = np.lexsort((smallest[of_row], score, of_q))
            of_q, of_row, score = of_q[order], of_row[order], score[order]
            top = np.arange(len(of_q)) - np.searchsorted(of_q, of_q) <= k
            of_q, of_row, score = of_q[top], of_row[top], score[top]
            found.append(pd.DataFrame({"asked": asks["asked"].to_numpy()[of_q], "score": score, "ids": held["ids"].to_numpy()[of_row], "rows": held["rows"].to_numpy()[of_row]}))
        return pd.concat(found) if found else pd.DataFrame(columns=["asked", "score", "ids", "rows"], dtype=object)

    def met(probed: DataFrame) -> DataFrame:
        """What the asked lists have for each query. Queries of a list are dealt to groups of ASKS, for each of which the list is repeated."""
        groups = keep(probed.groupBy("list", "part").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("_groups")), "groups")
        asks = probed.join(groups, ["list", "part"]).withColumn("group", F.pmod(F.xxhash64("asked"), "_groups").cast("int")).drop("_groups")
        held = members.join(groups, ["list", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")
        key = ["list", "part", "group"]
        return asks.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(compare, "asked string, score double, ids array<long>, rows array<long>")

    schema = "asked string, v array<double>, list int, part int, bound double"
    first = keep(met(keep(asked.mapInPandas(probe, schema), "probes")), "first")
    #: A class counts as often as it has ids, and the query's own row is one of them.
    nearest_of = Window.partitionBy("asked").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = first.withColumn("_n", F.sum(F.size("ids")).over(nearest_of)).where(F.col("_n") > k).groupBy("asked").agg(F.min("score").alias("bound"))
    bounded = asked.join(bounds.withColumnRenamed("asked", "same"), "same", "left").withColumn("bound", F.coalesce(F.pow("bound", F.lit(2.0)), F.lit(math.inf)))
    more = keep(met(keep(bounded.mapInPandas(probe, schema), "probes")), "more")
    met_all = first.union(more)
    nearest_first = Window.partitionBy("asked").orderBy("score", F.col("ids")[0])
    best = met_all.withColumn("_n", F.row_number().over(nearest_first)).where(F.col("_n") <= k + 1)
    best = best.select("asked", "score", F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("rows").alias("row"))).alias("c"))
    best = best.withColumn("_n", F.row_number().over(Window.partitionBy("asked").orderBy("score", "c"))).where(F.col("_n") <= k + 1)
    answers = keep(best.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("score", "c"))).alias("near")), "answers")

    out = rows.where("asks").select("vec_id", "row", "same").join(answers, F.col("same") == F.col("asked"))
    near = F.slice(F.filter("near", lambda x: x["c"]["row"] != F.col("row")), 1, k)
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(near).alias("_at", "_n"))
    return keep(out.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_n.c.vec_id").alias("vec_id"), F.col("_n.score").alias("score")), "nearest")
