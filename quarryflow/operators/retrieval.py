"""Keyword and vector retrieval, and routing of requests."""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) > 2))


def keyword_topk(docs: DataFrame, key: str, text: str, query: str, k: int = 10) -> DataFrame:
    """The k best documents by shared words over the geometric mean of the word counts; those without any are left out."""
    wanted = sorted({t for t in re.findall("[a-z0-9_]+", query.lower()) if len(t) > 2})
    found = terms(F.col(text))
    df = docs.select(key, F.size(F.array_intersect(found, F.array(*map(F.lit, wanted)))).alias("_both"), F.size(found).alias("_n"))
    df = df.where("_both > 0").select(key, F.round(F.col("_both") / F.sqrt(F.col("_n") * F.lit(float(len(wanted)))), 6).alias("score"))
    return df.orderBy(F.desc("score"), key).limit(k)


def embedding_topk(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 10) -> DataFrame:
    """The k vectors with the largest cosine against the query."""
    norm = sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*(F.lit(float(x) / norm) for x in query))
    v = F.col(vector).cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.select(key, F.round(dot / F.greatest(length, F.lit(1e-12)), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


#: Words that ask for a conversion.
CONVERTS = r"\bconvert\b|\bmigrate\b|\btranslate\b|\btransform\b"
#: Intent, pattern of the request, whether it must ask for a conversion (None: either), whether SQL may
#: come with it. The first row that holds counts.
INTENTS = (
    ("full", r"\bpandas\b|\bpyspark\b|\bspark\b|\bdataframe\b|\bpython\b", None, True),
    ("dbt", r"\bdbt\b|feature mart", None, True),
    ("full", r"\brisk\b|complex|score|explain|null|behavior", True, True),
    ("risk", r"\brisk\b|complex|score", False, True),
    ("rag", r"\bnull\b|timezone|behavior|rag|difference", None, False),
    ("explain", r"\bexplain\b|why|how", False, True),
    ("full", "", True, True),
)
OTHER_INTENT = "rag"


def intent(prompt: Column, sql: Column) -> Column:
    """Which tool a request needs, by the rows of INTENTS."""
    request, given = F.lower(F.coalesce(prompt, F.lit(""))), F.coalesce(sql, F.lit("")) != ""
    wants = request.rlike(CONVERTS) | given

    def holds(pattern: str, conversion: bool | None, with_sql: bool) -> Column:
        rule = request.rlike(pattern) if pattern else F.lit(True)
        rule = rule if conversion is None else rule & (wants == conversion)
        return rule if with_sql else rule & ~given

    return F.coalesce(*(F.when(holds(*row), F.lit(name)) for name, *row in INTENTS), F.lit(OTHER_INTENT))


def intent_sql(request: str) -> str:
    """The same for requests without SQL, as a CASE expression of DuckDB."""
    wants = f"regexp_matches({request}, '{CONVERTS}')"
    rules = []
    for name, pattern, conversion, _ in INTENTS:
        parts = [f"regexp_matches({request}, '{pattern}')"] if pattern else []
        parts += [] if conversion is None else [wants if conversion else f"NOT {wants}"]
        rules.append(f"WHEN {' AND '.join(parts)} THEN '{name}'")
    return f"CASE {' '.join(rules)} ELSE '{OTHER_INTENT}' END"


#: Postings of one term that a task gets, about; a more frequent term is dealt to several parts.
PART = 65_536
#: Requests, and rows, that are compared as one block of vectors.
ASKS, ROWS = 1024, 8192


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, n: the inverted index; n is the number of the document's terms. Write it once, ask it often."""
    found = docs.select(F.col(key).alias("key"), terms(F.col(text)).alias("_terms"))
    return found.select(F.explode("_terms").alias("term"), "key", F.size("_terms").alias("n"))


def keyword_topk_many(index: DataFrame, requests: DataFrame, request: str, text: str, k: int = 10) -> DataFrame:
    """request, rank, key, score: for each request the k best documents of the index, scored as keyword_topk does.

    Requests are joined with the postings of their terms, and shared terms are counted before documents of a request
    meet. Postings of a frequent term lie in several parts by document, and requests with it go to each of them.
    Requests or texts without terms, and nulls, find nothing; equal scores go to the smaller key.
    """
    asked = requests.select(F.col(request).alias("request"), terms(F.col(text)).alias("_terms"))
    asked = asked.select("request", F.explode("_terms").alias("term"), F.size("_terms").alias("_wanted"))
    counts = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    asked = asked.join(counts, "term").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    held = index.join(counts, "term").withColumn("_part", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int"))
    both = asked.join(held.select("term", "_part", "key", "n"), ["term", "_part"])
    scores = both.groupBy("request", "key").agg(F.round(F.count("*") / F.sqrt(F.first("n") * F.first("_wanted").cast("double")), 6).alias("score"))
    best = Window.partitionBy("request").orderBy(F.desc("score"), "key")  # Spark keeps k rows a request before it shuffles
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("request", "rank", "key", "score")


def routed_topk(requests: DataFrame, vectors: DataFrame, key: str, vector: str, route: str, k: int = 10) -> DataFrame:
    """request, rank, key, score, routed: for each request the k vectors with the largest cosine among those of its route.

    requests: request, route, v; vectors: key, vector and route. A request whose route is null or no vector has asks all
    vectors (routed is false). Which one holds is found by a join, without asking the driver. Requests and vectors meet
    in blocks, requests by vectors of one route, so a task holds two blocks and nothing else; each block pair gives k
    rows a request. Vectors and requests that are null, empty, zero, hold null or non-finite components or have different
    lengths take no part; equal scores (6 places) go to the smaller key.
    """
    whole = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x))
    good = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull()) & F.exists(c, lambda x: x != 0), F.lit(False))
    held = vectors.select(F.col(key).alias("key"), whole(vector).alias("v"), F.col(route).alias("route")).where(good("v"))
    asked = requests.select("request", F.col("route").alias("wanted"), whole("v").alias("v")).where(good("v"))
    dims = lambda df: df.withColumn("dims", F.size("v"))
    held, asked = dims(held), dims(asked)
    sizes = held.groupBy("dims", "route").agg(F.count("*").alias("_n"))
    own = sizes.where("route IS NOT NULL").select(F.col("dims"), F.col("route").alias("wanted"), F.lit(True).alias("routed"))
    asked = asked.join(own, ["dims", "wanted"], "left").withColumn("routed", F.coalesce("routed", F.lit(False)))
    asked = asked.withColumn("wanted", F.when(F.col("routed"), F.col("wanted")))
    # blocks: of vectors by route, and of all vectors for requests without one
    alls = sizes.groupBy("dims").agg(F.sum("_n").alias("_n")).select("dims", F.lit(None).cast(held.schema["route"].dataType).alias("wanted"), "_n")
    shape = sizes.where("route IS NOT NULL").select("dims", F.col("route").alias("wanted"), "_n").union(alls)
    shape = shape.select("dims", "wanted", F.ceil(F.col("_n") / ROWS).cast("int").alias("_blocks"))
    lots = asked.groupBy("dims", "wanted").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("_lots"))
    shape = shape.join(lots, shape["dims"].eqNullSafe(lots["dims"]) & shape["wanted"].eqNullSafe(lots["wanted"])).select(shape["dims"], shape["wanted"], "_blocks", "_lots")
    shape = shape.select(F.struct("dims", "wanted").alias("group"), "_blocks", "_lots")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.withColumn("group", F.struct("dims", "wanted")).join(shape, "group").withColumn("lot", deal("request", "_lots")).withColumn("block", each("_blocks"))
    routes = F.array_compact(F.array(F.struct("dims", F.lit(None).cast(held.schema["route"].dataType).alias("wanted")), F.when(F.col("route").isNotNull(), F.struct("dims", F.col("route").alias("wanted")))))
    held = held.withColumn("group", F.explode(routes)).join(shape, "group").withColumn("block", deal("key", "_blocks")).withColumn("lot", each("_lots"))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((asked, "request"), (held, "key"))}

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"request": one["request"][:0], "routed": one["routed"][:0], "key": two["key"][:0], "score": np.zeros(0)})
        if not len(one) or not len(two):
            return empty
        q, x = (np.array(df["v"].tolist()) for df in (one, two))
        cosine = np.round((q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]), 6)
        order = np.argsort(two["key"].to_numpy(), kind="stable")
        cosine, keys = cosine[:, order], two["key"].to_numpy()[order]
        best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(one)), best.shape[1])
        return pd.DataFrame({"request": one["request"].to_numpy()[rows], "routed": one["routed"].to_numpy()[rows], "key": keys[best.ravel()], "score": np.take_along_axis(cosine, best, 1).ravel()})

    by = ["group", "lot", "block"]
    found = asked.select(*by, "request", "routed", "v").groupBy(*by).cogroup(held.select(*by, "key", "v").groupBy(*by))
    found = found.applyInPandas(compare, f"request {kinds['request']}, routed boolean, key {kinds['key']}, score double")
    best = Window.partitionBy("request").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("request", "rank", "key", "score", "routed")
