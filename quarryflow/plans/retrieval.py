"""Queries of retrieval, lateral joins, table functions and held-out models, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.functions import registry
from quarryflow.operators import graph, retrieval, risk_model
from quarryflow.plans import analysis
from quarryflow.sources.tables import plain_sql, run_sql, table

#: The three dearest orders of each customer; customers without any are left out.
LATERAL_TOPN = """SELECT c_custkey, c_nationkey, o.o_orderkey, o.o_totalprice FROM {customer},
LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) AS o"""
#: The same with a count, for every customer.
LATERAL_LEFT = """SELECT c_custkey, o.n, o.last FROM {customer} LEFT JOIN LATERAL (SELECT COUNT(*) AS n, MAX(o_orderkey) AS last FROM {orders} WHERE o_custkey = c_custkey) AS o ON TRUE"""
#: Orders by bands that stand in the query.
VALUES_JOIN = """SELECT b.band, b.lo, COUNT(o_orderkey) AS n FROM (VALUES ('small', 0, 50000), ('middle', 50000, 200000), ('large', 200000, NULL), ('none', -2, -1)) AS b(band, lo, hi)
LEFT JOIN {orders} ON o_totalprice >= b.lo AND (b.hi IS NULL OR o_totalprice < b.hi) GROUP BY b.band, b.lo"""


def keyword_topk_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item as a request: its five best documents."""
    index = retrieval.postings(table(spark, folder, "documents"), "doc_id", "text")
    return retrieval.keyword_topk_many(index, table(spark, folder, "benchmark"), "item_id", "text", 5).select(F.col("request").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


def vector_topk_routed(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector whose id is divisible by 50 asks for those of the next label but one; labels 10 and 11 don't exist, so some ask all."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    requests = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("request"), (F.col("label") + 2).alias("route"), F.col("embedding").alias("v"))
    return retrieval.routed_topk(requests, vectors, "vec_id", "embedding", "label", 5).select("request", "rank", F.col("key").alias("vec_id"), "score", "routed")


def sentence_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of every document by a registered table function: counts by language and length."""
    registry.register(spark)
    text = "SELECT lang, LEAST(s.words, 20) AS words, COUNT(*) AS n, MAX(s.place) AS last FROM sentences_of(TABLE(SELECT lang, text FROM {documents})) AS s GROUP BY lang, LEAST(s.words, 20)"
    return run_sql(spark, folder, text)


def risk_ml_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """A model from two thirds of the objects, judged on the others: by level and prediction, rows and the mean probability."""
    assessed = graph.cut(analysis._assessed(spark, folder).select("id", "source_sql", "level"))
    part = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3)) == 1
    found = risk_model.predict(risk_model.fit(assessed.where(~part)), assessed.where(part))
    chance = F.element_at("probabilities", F.col("predicted"))
    return found.groupBy("level", "predicted").agg(F.count("*").alias("n"), F.round(F.avg(chance), 4).alias("confidence"))


def _sql(text: str):
    return lambda spark, folder: run_sql(spark, folder, text)


QUERIES = {
    "keyword_topk_batch": keyword_topk_batch,
    "vector_topk_routed": vector_topk_routed,
    "lateral_topn": _sql(LATERAL_TOPN),
    "lateral_left": _sql(LATERAL_LEFT),
    "values_join": _sql(VALUES_JOIN),
    "sentence_lengths": sentence_lengths,
    "lineage_neighbor_rows": lambda s, d: graph.neighbour_rows(analysis.key_edges(s, d)),
    "risk_ml_held_out": risk_ml_held_out,
}

ORACLES = {
    "keyword_topk_batch": f"""WITH d AS (SELECT doc_id, {analysis._DUCK_TERMS} AS t FROM documents), r AS (SELECT item_id, {analysis._DUCK_TERMS} AS t FROM benchmark),
s AS (SELECT item_id, doc_id, ROUND(len(list_intersect(d.t, r.t)) / sqrt(len(d.t) * CAST(len(r.t) AS DOUBLE)), 6) AS score FROM d, r WHERE len(list_intersect(d.t, r.t)) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
    "vector_topk_routed": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CAST(label AS BIGINT) AS label FROM embeddings),
q AS (SELECT vec_id AS request, e, label + 2 AS route, label + 2 IN (SELECT label FROM v) AS routed FROM v WHERE vec_id % 50 = 0),
s AS (SELECT request, v.vec_id, ROUND(list_cosine_similarity(v.e, q.e), 6) AS score, routed FROM q JOIN v ON (NOT routed OR v.label = q.route))
SELECT request, rank, vec_id, score, routed FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY request ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "lateral_topn": plain_sql(LATERAL_TOPN),
    "lateral_left": plain_sql(LATERAL_LEFT),
    "values_join": plain_sql(VALUES_JOIN),
    "sentence_lengths": """WITH p AS (SELECT lang, LEAST(len(regexp_extract_all(u.sentence, '[^ \\t\\n\\r]+')), 20) AS words, u.place - 1 AS place FROM (SELECT lang, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^ \\t\\n\\r]')) AS l FROM documents) d, LATERAL (SELECT UNNEST(l) AS sentence, generate_subscripts(l, 1) AS place) u)
SELECT lang, CAST(words AS INTEGER) AS words, COUNT(*) AS n, CAST(MAX(place) AS INTEGER) AS last FROM p GROUP BY 1, 2""",
    "lineage_neighbor_rows": f"WITH {analysis._DUCK_EDGES} SELECT DISTINCT src AS node, 'downstream' AS direction, dst AS neighbour FROM edges UNION SELECT dst, 'upstream', src FROM edges",
}
