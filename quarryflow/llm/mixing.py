"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 5).

Each source's documents lie in a random order of blocks. Its target gives an exact quota of blocks: whole passes over
the source and a last part of a pass, whose last document is cut where the target is met. The tree then deals the
quotas out: at each node a multivariate-hypergeometric draw says how many of the node's blocks, by source, go to the
left half of its output shards. A shard walks its own way down the tree with seeds that depend on the node alone, so
every shard finds the same splits without any table of them. It takes its blocks as the next ones of each source's
order, which keeps them disjoint, and shuffles what they hold.

Defined cases: null text has size 0; documents of size 0 are never taken; null sources form one source, the last; null
doc_ids are dealt like others; repeated rows count each on their own; an empty table gives no rows; other columns are
untouched and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryflow.llm.common import WORD, keep, numbered, small, tidy

_WORD = re.compile(WORD)
WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents a block, on average.
BLOCK = 2048
#: Words an output shard, on average; the number of shards is the next power of two.
SHARD_WORDS = 4_000_000


def text_size(text: str = "text") -> F.Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add source_index, weight and target to one row a source with its source_size.

    Raising one common level until the targets level * weight, stopped at most * source_size, add up to all sizes is
    what resharing the excess again and again ends in. Ordered by most * source_size / weight, the stopped sources come
    first, so two running sums give the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*map(F.lit, weights))
    df = sources.withColumn("source_index", F.row_number().over(by_name) - 1)
    df = df.withColumn("weight", F.get(table, F.col("source_index") % len(weights)))
    df = df.withColumn("_cap", F.col("source_size") * most).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    ordered = Window.orderBy("_ratio", "source_index")
    df = df.withColumn("_before", F.coalesce(F.sum("_cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("_rest", F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.orderBy("_ratio").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_level", (F.sum("source_size").over(every) - F.col("_before")) / F.col("_rest"))
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(every)
    target = F.when(F.col("_ratio") <= F.col("_level"), F.col("_cap").cast("double")).otherwise(level * F.col("weight"))
    return df.withColumn("target", target).drop("_cap", "_ratio", "_before", "_rest", "_level")


def shard_draws(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For one shard: by source, how many blocks earlier shards draw and how many it draws itself."""
    left, start, node, span = quotas.copy(), np.zeros_like(quotas), 1, shards
    while span > 1:
        half = np.random.default_rng([seed, node]).multivariate_hypergeometric(left, int(left.sum()) // 2, method="marginals")
        span //= 2
        right = bool(shard & span)
        if right:
            start, left = start + half, left - half
        else:
            left = half
        node = 2 * node + right
    return start, left


def running_totals(blocks: DataFrame, value: str, before: str, group: int = 4096) -> DataFrame:
    """Add, as column before, the sum of value over the source's blocks of smaller number.

    Blocks are summed by groups first, so no task sorts all blocks of a source.
    """
    blocks = blocks.withColumn("_group", F.floor(F.col("_block") / group))
    earlier = Window.partitionBy("source_index").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("source_index", "_group").agg(F.sum(value).alias("_sum"))
    groups = groups.select("source_index", "_group", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source_index", "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_sum", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return blocks.join(groups, ["source_index", "_group"]).withColumn(before, F.col("_start") + F.col("_sum")).drop("_group", "_start", "_sum")


@tidy
def draws_of(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 5, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """row, doc_id, source, size, source_size, target and draws of each of rows (row, doc_id, source, text), kept.

    draws holds one struct for each time that the mix takes from the document: copy (number of the pass), words (the
    whole size, or fewer where the last block of a quota is cut), shard and place (sort key within the shard).
    Sources are collections with a name; one number a source reaches the driver and every shard.
    """
    spark = rows.sparkSession
    df = rows.select("row", "doc_id", "source", text_size().alias("size"))
    df = keep(df.withColumn("_key", F.xxhash64(F.lit(seed), F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.col("doc_id")))), "sized")

    totals = keep(df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs")), "sources")
    table = source_targets(totals, weights, most)
    table = table.withColumn("_quota", F.rint("target").cast("long"))
    table = table.withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("_quota") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    table = table.withColumn("_rest", F.col("_quota") - F.col("_passes") * F.col("source_size"))
    table = keep(table.withColumn("_blocks", F.ceil(F.col("_docs") / block).cast("long")).drop("_quota", "weight", "_docs"), "targets")
    n_sources = table.count()

    names = small(table.withColumnRenamed("source", "_source"), n_sources)
    df = df.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    df = df.withColumn("_block", F.pmod("_key", "_blocks"))

    blocks = df.groupBy("source_index", "_block").agg(F.sum("size").alias("_words"), F.first("_passes").alias("_passes"), F.first("_rest").alias("_rest"))
    blocks = blocks.withColumn("_held", (F.col("_words") > 0).cast("long"))
    blocks = running_totals(keep(running_totals(blocks, "_words", "_before"), "blocks"), "_held", "_rank")
    #: Blocks are drawn in their order, pass by pass; blocks that hold no word are never drawn.
    drawn = F.col("_passes") + (F.col("_rest") > F.col("_before")).cast("long")
    blocks = keep(blocks.withColumn("_drawn", F.when(F.col("_held") > 0, drawn).otherwise(0)), "drawn")

    per_source = blocks.groupBy("source_index").agg(F.sum("_drawn").alias("n"), F.sum("_words").alias("w"), F.sum("_held").alias("_held_all"))
    per_source = keep(per_source, "per_source")
    totals = per_source.orderBy("source_index").collect()
    quotas = np.array([r["n"] for r in totals], np.int64)
    words = sum(r["w"] for r in totals)
    shards = 1 << max(0, int(np.ceil(np.log2(max(1.0, words / shard_words)))))

    #: A whole pass draws every block that holds words, the last one the first of them: a turn's number needs no sort.
    turns = blocks.where("_drawn > 0").join(small(per_source.select("source_index", "_held_all"), n_sources), "source_index")
    turns = turns.select("source_index", "_block", "_rank", "_held_all", F.explode(F.sequence(F.lit(0), (F.col("_drawn") - 1).cast("int"))).alias("_copy"))
    turns = turns.withColumn("_ordinal", F.col("_copy") * F.col("_held_all") + F.col("_rank"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                start, own = shard_draws(quotas, int(shard), shards, seed)
                yield pd.DataFrame({"_source": np.arange(len(quotas)), "_start": start, "_own": own, "_shard": int(shard)})

    leaves = spark.range(shards).mapInPandas(walk, "_source int, _start long, _own long, _shard long").where("_own > 0")
    dealt = leaves.select("_source", "_shard", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_own") - 1)).alias("_dealt"))
    shard_of = turns.join(dealt, (F.col("source_index") == F.col("_source")) & (F.col("_ordinal") == F.col("_dealt")))
    shard_of = shard_of.groupBy("source_index", "_block").agg(F.sort_array(F.collect_list(F.struct(F.col("_copy").alias("copy"), F.col("_shard").alias("shard")))).alias("_turns"))
    placed = blocks.select("source_index", "_block", "_before").join(shard_of, ["source_index", "_block"], "left")

    within = Window.partitionBy("source_index", "_block").orderBy("_key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(placed, ["source_index", "_block"])
    df = df.withColumn("_before", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = F.least(F.greatest(F.col("_rest") - F.col("_before"), F.lit(0)), F.col("size"))
    draws = F.transform(
        F.coalesce("_turns", F.array().cast("array<struct<copy:int,shard:bigint>>")),
        lambda t: F.struct(
            t["copy"].alias("copy"),
            F.when(t["copy"] < F.col("_passes"), F.col("size")).otherwise(last).alias("words"),
            t["shard"].alias("shard"),
            F.xxhash64(F.lit(seed), t["shard"], t["copy"], F.col("_key"), F.col("row")).alias("place"),
        ),
    )
    df = df.withColumn("draws", F.filter(draws, lambda t: t["words"] > 0))
    return keep(df.select("row", "doc_id", "source", "size", "source_size", "target", "draws"), "draws")


def mix_plan(docs: DataFrame, stored: bool = False, **options) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target and draws, as draws_of gives them."""
    return draws_of(of_mix(numbered(docs, stored)), **options).drop("row")


def of_mix(rows: DataFrame) -> DataFrame:
    return rows.select("row", *(F.col(f"doc.{c}").alias(c) for c in ("doc_id", "source", "text")))


def words_taken(draws: str = "draws") -> F.Column:
    return F.aggregate(draws, F.lit(0).cast("long"), lambda total, t: total + t["words"])


def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """Each text up to the end of so many words; null stays null."""
    ends = [None if text is None else next(islice(_WORD.finditer(text), int(n) - 1, None)).end() for text, n in zip(texts, counts, strict=True)]
    return pd.Series([text if end is None else text[:end] for text, end in zip(texts, ends, strict=True)], dtype=object)


def drawn_documents(docs: DataFrame, stored: bool = False, **options) -> DataFrame:
    """The mix itself, one row a draw: doc (struct of the document's columns) and mix (struct of copy, words, shard, place).

    Where a draw has fewer words than the document, its text ends after its last drawn word, and n_chars, if there is
    one, is counted anew.
    """
    docs_by_row = numbered(docs, stored)
    plan = draws_of(of_mix(docs_by_row), **options).where(F.size("draws") > 0)
    rows = docs_by_row.join(plan.select("row", "size", "draws"), "row").select("doc", "size", F.explode("draws").alias("mix"))
    whole = F.col("mix.words") >= F.col("size")
    cut = F.pandas_udf(first_words, "string")(F.when(~whole, F.col("doc.text")), F.col("mix.words"))
    rows = rows.withColumn("_text", F.when(whole, F.col("doc.text")).otherwise(cut))
    new = {"text": F.col("_text"), "n_chars": F.when(whole, F.col("doc.n_chars")).otherwise(F.length("_text")).cast("long") if "n_chars" in docs.columns else None}
    columns = [(F.col(f"doc.`{c}`") if new.get(c) is None else new[c]).alias(c) for c in docs.columns]
    return rows.select(F.struct(*columns).alias("doc"), "mix")


def mix_documents(docs: DataFrame, stored: bool = False, **options) -> DataFrame:
    """drawn_documents with the document's columns, mix_copy, mix_words, mix_shard and mix_place side by side."""
    return drawn_documents(docs, stored, **options).select("doc.*", *(F.col(f"mix.{c}").alias(f"mix_{c}") for c in ("copy", "words", "shard", "place")))


def in_shards(drawn: DataFrame) -> DataFrame:
    """drawn_documents with every shard's rows together, each shard in its own shuffled order."""
    return drawn.repartition(F.col("mix.shard")).sortWithinPartitions("mix.shard", "mix.place")


def write_shards(drawn: DataFrame, path: str) -> None:
    """Write drawn_documents as one folder a shard, each in its own shuffled order."""
    in_shards(drawn).withColumn("shard", F.col("mix.shard")).write.partitionBy("shard").parquet(path)
