"""Queries of the operators that are functions over DataFrames, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.functions import dialect
from quarryflow.operators import assess, graph, incremental, reconcile, retrieval, risk_model, text_metrics
from quarryflow.plans import estate
from quarryflow.sources import repository
from quarryflow.sources.tables import plain_sql, run_sql, table

#: SQL objects made from the supplier and part tables by the same text in both engines; those of parts have negative ids.
OBJECTS = """SELECT s_suppkey AS id, 'repo/obj_' || CAST(s_suppkey AS STRING) || '.sql' AS path, CASE CAST(s_suppkey % 7 AS INT)
  WHEN 0 THEN 'CREATE OR REPLACE PROCEDURE etl.p_' || CAST(s_suppkey AS STRING) || ' AS BEGIN DELETE FROM mart.daily WHERE load_date = 1; INSERT INTO mart.daily SELECT CASE WHEN a > 1 THEN ''x'' ELSE ''y'' END FROM staging.orders o JOIN staging.customers c ON o.k = c.k; END'
  WHEN 1 THEN 'CREATE VIEW rpt.v_' || CAST(s_suppkey AS STRING) || ' AS WITH t AS (SELECT k, ZEROIFNULL(v) AS v FROM staging.orders) SELECT k, SUM(v) OVER (PARTITION BY k) AS s FROM t'
  WHEN 2 THEN 'CREATE LOCAL TEMP TABLE tmp_' || CAST(s_suppkey AS STRING) || ' AS SELECT k, NVL(v, 0) AS v FROM staging.events'
  WHEN 3 THEN 'CREATE TABLE staging.t_' || CAST(s_suppkey AS STRING) || ' (k INT, v DECIMAL(18,2)) SEGMENTED BY HASH(k) ALL NODES'
  WHEN 4 THEN 'SELECT COUNT(*), MAX(x) FROM rpt.v_1 WHERE k IN (SELECT k FROM mart.daily) AND updated_at > 5'
  WHEN 5 THEN 'MERGE INTO mart.customers USING staging.customers s ON mart.customers.k = s.k WHEN MATCHED THEN UPDATE SET v = 1'
  ELSE 'CREATE FUNCTION util.f_' || CAST(s_suppkey AS STRING) || '(x INT) RETURN INT AS BEGIN EXECUTE IMMEDIATE ''SELECT 1''; DECLARE CURSOR c; END' END AS source_sql
FROM {supplier}
UNION ALL SELECT -1 - p_partkey, 'repo/obj_' || CAST(-1 - p_partkey AS STRING) || '.sql', """ + estate.case_sql() + " FROM {part}"
_DUCK_OBJECTS = "objects AS (" + plain_sql(OBJECTS).replace("AS STRING", "AS VARCHAR") + ")"


def objects(spark: SparkSession, folder: str) -> DataFrame:
    """The texts are made once, dealt to all tasks and written to files.

    Otherwise each use would make them anew, and Spark would move conditions on what is found in a text to before the
    texts are dealt, into one task a file of the table. The number of tasks is given, since Spark would join parts that
    are small, and texts of few shapes are small as shuffled.
    """
    return graph.cut(run_sql(spark, folder, OBJECTS).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"))


def changed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A target of orders that lacks each hundredth row and has one total changed in fifty."""
    orders = table(spark, folder, "orders").where("o_orderkey % 100 <> 0")
    return orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


def key_edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst: region to nation to customer."""
    return run_sql(spark, folder, "SELECT 'r' || CAST(n_regionkey AS STRING) AS src, 'n' || CAST(n_nationkey AS STRING) AS dst FROM {nation} UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING) FROM {customer}")


_DUCK_EDGES = "edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


def ring_edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst: nations in rings of 3, 4 or 5 and a chain, without hubs."""
    return run_sql(spark, folder, "SELECT n_nationkey AS src, CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 4 ELSE n_nationkey + 1 END AS dst FROM {nation} WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_nationkey + 1 FROM {nation} WHERE n_nationkey >= 20")


TURNS = "SELECT CONCAT(a.conv_id, ':', a.turn) AS pair_id, a.conv_id, a.text AS predicted, b.text AS gold FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """pair_id, conv_id, predicted, gold: each turn of a conversation and the one after it."""
    return run_sql(spark, folder, TURNS)


_DUCK_NORMAL = "trim(replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '(?m)--.*?$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ';', ''))"
_DUCK_TOKENS = "regexp_extract_all({0}, '[a-z_][a-z0-9_]*|\\d+|[=<>!()*,.]')"
_DUCK_TURNS = f"turns AS ({plain_sql(TURNS)})"
_DUCK_EVAL = f"""{_DUCK_TURNS},
n AS (SELECT pair_id, conv_id, {_DUCK_NORMAL.format("predicted")} AS a, {_DUCK_NORMAL.format("gold")} AS b FROM turns),
t AS (SELECT *, {_DUCK_TOKENS.format("a")} AS ta, {_DUCK_TOKENS.format("b")} AS tb,
  list_distinct(list_transform(range(1, length(a)), lambda i: substring(a, i, 2))) AS ba, list_distinct(list_transform(range(1, length(b)), lambda i: substring(b, i, 2))) AS bb FROM n),
pa AS (SELECT pair_id, w, COUNT(*) AS c FROM (SELECT pair_id, UNNEST(ta) AS w FROM t) GROUP BY 1, 2),
pb AS (SELECT pair_id, w, COUNT(*) AS c FROM (SELECT pair_id, UNNEST(tb) AS w FROM t) GROUP BY 1, 2),
o AS (SELECT pa.pair_id, SUM(LEAST(pa.c, pb.c)) AS shared FROM pa JOIN pb ON pa.pair_id = pb.pair_id AND pa.w = pb.w GROUP BY 1),
e AS (SELECT t.pair_id, conv_id, CAST(a = b AS DOUBLE) AS exact_match, COALESCE(2.0 * CAST(shared AS DOUBLE) / (len(ta) + len(tb)), 0) AS token_f1,
  2.0 * len(list_intersect(ba, bb)) / (len(ba) + len(bb)) AS fuzzy FROM t LEFT JOIN o ON t.pair_id = o.pair_id)"""

QUERY_TEXT = "the with and licensed under version data password"


def _assessed(spark: SparkSession, folder: str) -> DataFrame:
    return assess.assess(objects(spark, folder))


def _unit_query(spark: SparkSession, folder: str) -> list[float]:
    first = table(spark, folder, "embeddings").where("vec_id = 0").select("embedding").head()
    return list(first["embedding"])


def recon_metric_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    return reconcile.metric_tolerance(table(spark, folder, "orders"), changed_orders(spark, folder), {"rows": F.count("*"), "total": money("o_totalprice"), "customers": F.countDistinct("o_custkey")}, 0.001)


def incr_delete_insert(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    fresh = events.where("day >= DATE '2024-01-28'").withColumn("value", F.col("value") * 2)
    return incremental.delete_insert(events, fresh, ["day"]).select("event_id", "day", F.round("value", 6).alias("value"))


def incr_merge(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    old = customers.where("c_custkey % 10 <> 0").select("c_custkey", "c_name", F.lit(0).alias("version"))
    new = customers.where("c_custkey % 5 = 0").select("c_custkey", F.lower("c_name").alias("c_name"), F.lit(1).alias("version"))
    newer = customers.where("c_custkey % 15 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(2).alias("version"))
    return incremental.merge_upsert(old, new.union(newer), ["c_custkey"], ["version"])


def incr_watermark(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts")
    return incremental.watermark_append(events.where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), events, "ts")


#: TO_CHAR formats by column.
CHAR_FORMATS = {"day": "YYYY-MM-DD", "month": "MM/YY", "time": "HH24:MI:SS"}


def date_diff_units(spark: SparkSession, folder: str) -> DataFrame:
    day, end = F.col("o_orderdate").cast("date"), F.lit("2001-08-01").cast("date")
    days = table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("key"), *(dialect.date_diff(u, day, end).alias(f"{u}s") for u in ("year", "quarter", "month", "week", "day")))
    return days.withColumn("hours", dialect.date_diff("hour", F.lit("2001-07-31 22:59:59").cast("timestamp"), F.lit("2001-08-01 01:00:00").cast("timestamp")))


def text_stats(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return table(spark, folder, "documents").select("doc_id", F.octet_length(text).cast("long").alias("bytes"), lines.cast("long").alias("lines"), F.length(text).cast("long").alias("chars"))


def token_count(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(text_metrics.tokens(F.col("text"))).cast("long").alias("n"))


def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text_metrics.normal_form(F.col("text")).alias("normal"))


def eval_pairs_scored(spark: SparkSession, folder: str) -> DataFrame:
    scored = text_metrics.evaluate(turns(spark, folder), "pair_id", "predicted", "gold")
    return scored.select("pair_id", "exact_match", F.round("token_f1", 6).alias("token_f1"), F.round("fuzzy", 6).alias("fuzzy"), "passed")


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    scored = text_metrics.evaluate(turns(spark, folder), "pair_id", "predicted", "gold").withColumn("category", (F.substring_index("pair_id", ":", 1).cast("long") % 3).cast("long"))
    return text_metrics.summary(scored, "category").select("category", "n_pairs", *(F.round(c, 4).alias(c) for c in ("exact_match", "token_f1", "fuzzy", "passed")))


def classify_objects(spark: SparkSession, folder: str) -> DataFrame:
    return objects(spark, folder).select("id", assess.object_type(F.col("path"), F.col("source_sql")).alias("object_type"), assess.object_name(F.col("path"), F.col("source_sql")).alias("name"))


def complexity_regex(spark: SparkSession, folder: str) -> DataFrame:
    return objects(spark, folder).select("id", *(c.alias(name) for name, c in assess.measures(F.col("source_sql")).items()))


def unsupported_features(spark: SparkSession, folder: str) -> DataFrame:
    return objects(spark, folder).select("id", F.array_join(assess.features(F.col("source_sql"), "vertica"), ",").alias("features"))


def lineage_edges(spark: SparkSession, folder: str) -> DataFrame:
    return assess.lineage_edges(objects(spark, folder))


def lineage_reads(spark: SparkSession, folder: str) -> DataFrame:
    return objects(spark, folder).select("id", F.array_join(assess.read_tables(F.col("source_sql")), ",").alias("reads"), F.array_join(assess.write_targets(F.col("source_sql")), ",").alias("writes"))


def column_transforms(spark: SparkSession, folder: str) -> DataFrame:
    return objects(spark, folder).select("id", F.array_join(assess.column_transforms(F.col("source_sql"), "v"), ",").alias("transforms"))


def business_rules(spark: SparkSession, folder: str) -> DataFrame:
    return objects(spark, folder).select("id", F.array_join(assess.business_rules(F.col("source_sql")), "; ").alias("rules"))


def incr_strategy(spark: SparkSession, folder: str) -> DataFrame:
    pattern = assess.load_pattern(F.col("source_sql"))
    return objects(spark, folder).select("id", pattern.alias("pattern"), assess.load_strategy(pattern).alias("strategy"))


def intent_route(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").groupBy(retrieval.intent(F.col("text"), F.lit("")).alias("intent")).agg(F.count("*").alias("n"))


def approx_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


def staged_daily(spark: SparkSession, folder: str) -> DataFrame:
    """A procedure's straight-line body as named stages, each a DataFrame over the ones before."""
    orders = table(spark, folder, "orders")
    tmp = orders.select("o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("spend"))
    daily = tmp.groupBy("o_custkey", "day").agg(F.count("*").alias("order_count"), F.sum("spend").cast("double").alias("total_spend"))
    return daily.withColumn("segment", F.when((F.col("order_count") >= 2) & (F.col("total_spend") > 100), "MEDIUM_VALUE").otherwise("STANDARD"))


def risk_ml(spark: SparkSession, folder: str) -> DataFrame:
    """Trained on the assessed levels of the objects and applied to all of them."""
    assessed = graph.cut(_assessed(spark, folder).select("id", "source_sql", "level"))
    return risk_model.predict(risk_model.fit(assessed), assessed).select("id", "level", "predicted", "hard")


def leaderboard_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as contestants, the best three."""
    board = run_sql(spark, folder, "SELECT event_type AS name, ROUND(COUNT_IF(value > 50) / COUNT(*), 6) AS pass_rate, ROUND(COUNT_IF(value > 20) / COUNT(*), 6) AS token_f1 FROM {events} GROUP BY event_type")
    return repository.append_leaderboard(board.where("name < 'p'"), board.where("name >= 'p'"), 3)


QUERIES = {
    "risk_ml": risk_ml,
    "leaderboard_topk": leaderboard_topk,
    "sample_tables": lambda s, d: repository.sample_table(s, {"load_date": "date", "customer_id": "id", "amount": "amount", "customer_name": "name", "note": "other"}),
    "join_semi": lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "join_anti": lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey"),
    "recon_row_count": lambda s, d: reconcile.row_counts(table(s, d, "orders"), changed_orders(s, d)),
    "recon_distinct_count": lambda s, d: reconcile.distinct_counts(table(s, d, "orders").select("o_custkey", "o_orderstatus"), changed_orders(s, d).select("o_custkey", "o_orderstatus")),
    "recon_null_rates": lambda s, d: reconcile.null_rates(table(s, d, "events").withColumn("value", F.expr("nullif(event_type, 'error')")), ["user_id", "event_type", "value"]),
    "recon_checksum": lambda s, d: reconcile.checksum(table(s, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]),
    "recon_sample_diff": lambda s, d: reconcile.sample_diff(table(s, d, "orders"), changed_orders(s, d), ["o_orderkey"]),
    "recon_metric_tolerance": recon_metric_tolerance,
    "incr_delete_insert": incr_delete_insert,
    "incr_merge": incr_merge,
    "incr_watermark": incr_watermark,
    "script_temp_then_query": staged_daily,
    "graph_out_degree": lambda s, d: graph.out_degree(key_edges(s, d)),
    "lineage_neighbors": lambda s, d: graph.neighbours(key_edges(s, d)),
    "graph_reachability": lambda s, d: graph.reachability(key_edges(s, d), run_sql(s, d, "SELECT 'r' || CAST(r_regionkey AS STRING) AS node FROM {region}"), 4),
    "graph_cycles": lambda s, d: graph.on_cycles(ring_edges(s, d), 6),
    "graph_orphans": lambda s, d: graph.orphans(key_edges(s, d), run_sql(s, d, "SELECT 'n' || CAST(n_nationkey AS STRING) AS node FROM {nation} UNION ALL SELECT 'c' || CAST(c_custkey AS STRING) FROM {customer}")),
    "classify_objects": classify_objects,
    "complexity_regex": complexity_regex,
    "unsupported_features": unsupported_features,
    "risk_score": lambda s, d: _assessed(s, d).select("id", "object_type", "score"),
    "risk_bucket": lambda s, d: _assessed(s, d).groupBy("level", "category", "action").agg(F.count("*").alias("n")),
    "rationalization": lambda s, d: assess.rationalization(_assessed(s, d)),
    "scope_reduction": lambda s, d: assess.scope_reduction(_assessed(s, d)),
    "table_columns": lambda s, d: assess.table_columns(objects(s, d)),
    "dashboard": lambda s, d: assess.dashboard(_assessed(s, d)),
    "lineage_edges": lineage_edges,
    "lineage_reads": lineage_reads,
    "column_transforms": column_transforms,
    "business_rules": business_rules,
    "ddl_schema": lambda s, d: assess.ddl_columns(objects(s, d)),
    "date_diff_units": date_diff_units,
    "to_char_format": lambda s, d: table(s, d, "orders").select("o_orderkey", *(dialect.to_char_format(F.col("o_orderdate").cast("timestamp"), f).alias(n) for n, f in CHAR_FORMATS.items())),
    "date_trunc_units": lambda s, d: table(s, d, "orders").select("o_orderkey", *(F.trunc(F.col("o_orderdate").cast("date"), u).alias(u) for u in ("year", "quarter", "month", "week"))),
    "update_rewrite": lambda s, d: incremental.update(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey") % 7 == 0, {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1}),
    "behavior_differences": lambda s, d: assess.behaviors(objects(s, d), "vertica", "snowflake"),
    "column_refs": lambda s, d: objects(s, d).select("id", F.array_join(assess.column_references(F.col("source_sql")), ",").alias("columns")),
    "column_lineage": lambda s, d: assess.column_lineage(objects(s, d)).withColumn("transforms", F.array_join("transforms", ",")),
    "column_usage": lambda s, d: assess.column_usage(objects(s, d)),
    "recon_value_diff": lambda s, d: reconcile.value_diff(table(s, d, "orders"), changed_orders(s, d), ["o_orderkey"], ["o_custkey", "o_totalprice"]),
    "graph_upstream": lambda s, d: graph.reachability(key_edges(s, d), run_sql(s, d, "SELECT 'c' || CAST(c_custkey AS STRING) AS node FROM {customer}"), 4, "upstream"),
    **{f"unsupported_features_{name}": lambda s, d, name=name: objects(s, d).select("id", F.array_join(assess.features(F.col("source_sql"), name), ",").alias("features")) for name in assess.FEATURES if name != "vertica"},
    "incr_strategy": incr_strategy,
    "text_stats": text_stats,
    "token_count": token_count,
    "text_normalize": text_normalize,
    "eval_pairs_scored": eval_pairs_scored,
    "eval_summary": eval_summary,
    "keyword_topk": lambda s, d: retrieval.keyword_topk(table(s, d, "documents"), "doc_id", "text", QUERY_TEXT, 10),
    "embedding_topk": lambda s, d: retrieval.embedding_topk(table(s, d, "embeddings"), "vec_id", "embedding", _unit_query(s, d), 10),
    "intent_route": intent_route,
    "approx_distinct": approx_distinct,
}

_CHANGED = "changed AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 100 <> 0)"


def _duck_count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


_DUCK_TYPE = "CASE WHEN contains(u, 'CREATE OR REPLACE PROCEDURE') OR contains(u, 'CREATE PROCEDURE') THEN 'stored_procedure' WHEN contains(u, 'CREATE OR REPLACE FUNCTION') OR contains(u, 'CREATE FUNCTION') THEN 'function' WHEN contains(u, 'CREATE VIEW') OR contains(u, 'CREATE OR REPLACE VIEW') THEN 'view' WHEN contains(u, 'CREATE TABLE') OR contains(u, 'CREATE LOCAL TEMP') THEN CASE WHEN contains(u, 'TEMP') THEN 'temp_table' ELSE 'table' END ELSE 'sql_script' END"
_DUCK_NAME = "upper(coalesce(nullif(regexp_extract(source_sql, '(?i)CREATE\\s+(?:OR\\s+REPLACE\\s+)?(?:PROCEDURE|FUNCTION)\\s+([\\w.]+)', 1), ''), nullif(regexp_extract(source_sql, '(?i)CREATE\\s+(?:OR\\s+REPLACE\\s+)?VIEW\\s+([\\w.]+)', 1), ''), nullif(regexp_extract(source_sql, '(?i)CREATE\\s+(?:LOCAL\\s+TEMP|TEMP|TEMPORARY)?\\s*TABLE\\s+([\\w.]+)', 1), ''), 'OBJ_' || id))"


def _duck_features(dialect: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(u, '{p}') THEN '{n}' END" for n, p in assess.FEATURES[dialect]) + "], lambda x: x IS NOT NULL)"


def _vertica_rules() -> list[tuple[str, str, str]]:
    """The rules as SQL values; DuckDB has no look-ahead, so the ordering rule is spelled out in the query."""
    return [(n, "x{1000}" if n == "default_ordering" else p.replace("'", "''"), v) for n, a, b, p, v in assess.BEHAVIORS if (a, b) == ("vertica", "snowflake")]


_DUCK_FEATURES = _duck_features("vertica")
_DUCK_UPPER = "list_transform({0}, lambda x: upper(x))"
_DUCK_READS = "list_sort(list_distinct(list_filter(" + _DUCK_UPPER.format(f"regexp_extract_all(source_sql, '{assess.READS}', 1)") + ", lambda x: NOT list_contains(" + _DUCK_UPPER.format(f"regexp_extract_all(source_sql, '{assess.CTE_NAMES}', 1)") + ", x))))"
_DUCK_WRITES = "list_sort(list_distinct(" + _DUCK_UPPER.format(" || ".join(f"regexp_extract_all(source_sql, '{p}', 1)" for p in assess.WRITES)) + "))"
_DUCK_PLAIN = f"regexp_replace(source_sql, '{assess.TABLE_NAMES}', ' ', 'g')"
_DUCK_COLUMNS = f"list_sort(list_distinct(list_transform(list_concat(regexp_extract_all({_DUCK_PLAIN}, '{assess.QUALIFIED}', 1), list_transform(regexp_extract_all({_DUCK_PLAIN}, '{assess.UNQUALIFIED}', 1), lambda c: '_UNQUALIFIED.' || c)), lambda c: upper(c))))"
_DUCK_TAGS = ", ".join(f"CASE WHEN regexp_matches(u, replace('{p}', '{{c}}', col)) THEN '{n}' END" for n, p in assess.TRANSFORMS)
_DUCK_LINEAGE = f"""{_DUCK_OBJECTS}, n AS (SELECT {_DUCK_NAME} AS name, upper(source_sql) AS u, UNNEST({_DUCK_COLUMNS}) AS source_column FROM objects),
p AS (SELECT *, split_part(source_column, '.', 2) AS col FROM n), g AS (SELECT *, list_filter([{_DUCK_TAGS}], lambda x: x IS NOT NULL) AS tags FROM p)"""
_DUCK_ASSESSED = f"""{_DUCK_OBJECTS}, u AS (SELECT *, upper(source_sql) AS u FROM objects),
nm AS (SELECT {_DUCK_NAME} AS name, {_DUCK_READS} AS r, {_DUCK_WRITES} AS w FROM objects),
ed AS (SELECT DISTINCT src, dst FROM (SELECT UNNEST(r) AS src, name AS dst FROM nm UNION ALL SELECT name, UNNEST(w) FROM nm) WHERE src <> dst),
k AS (SELECT *, COALESCE((SELECT COUNT(*) FROM ed WHERE ed.dst = {_DUCK_NAME}), 0) AS deps, COALESCE((SELECT COUNT(*) FROM ed WHERE ed.src = {_DUCK_NAME}), 0) AS downs, {_DUCK_TYPE} AS object_type, len({_DUCK_FEATURES}) AS nf, {", ".join(_duck_count("source_sql", p) + " AS " + n for n, p in assess.MEASURES)} FROM u),
s AS (SELECT *, CAST(LEAST(100, {" + ".join(f"CASE WHEN {n} >= {least} THEN {points} ELSE 0 END" for n, least, points in assess.POINTS)} + LEAST(nf * 5, 25)
  + CASE WHEN len(string_split(source_sql, chr(10))) > 2000 THEN 25 WHEN len(string_split(source_sql, chr(10))) > 500 THEN 12 WHEN len(string_split(source_sql, chr(10))) > 100 THEN 5 ELSE 0 END
  + CASE object_type {" ".join(f"WHEN '{t}' THEN {p}" for t, p in assess.TYPE_POINTS.items())} ELSE 5 END + CASE WHEN deps > 10 THEN 10 WHEN deps > 3 THEN 4 ELSE 0 END + CASE WHEN downs > 5 THEN 12 WHEN downs > 0 THEN 3 ELSE 0 END + CASE WHEN case_expressions > 5 THEN 8 ELSE 0 END) AS BIGINT) AS score FROM k),
c AS (SELECT *, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN object_type = 'temp_table' AND score < 30 THEN 'retire' WHEN score >= 80 THEN 'manual_redesign' WHEN score >= 55 THEN 'partial' WHEN score >= 30 THEN 'auto_with_review' ELSE 'auto_migrate' END AS category FROM s),
a AS (SELECT *, CASE WHEN score >= 80 THEN 'manual_redesign' WHEN score >= 60 THEN 'rewrite' WHEN category = 'retire' THEN 'retire' WHEN score >= 35 THEN 'review_and_migrate' ELSE 'migrate' END AS action FROM c)"""
_DUCK_TABLE_LINEAGE = f"""{_DUCK_OBJECTS}, t AS (SELECT *, list_distinct(list_concat({_DUCK_READS}, {_DUCK_WRITES})) AS tbls FROM objects),
n AS (SELECT tbls, {_DUCK_NAME} AS name, upper(source_sql) AS u, UNNEST({_DUCK_COLUMNS}) AS source_column FROM t),
p AS (SELECT *, split_part(source_column, '.', 2) AS col FROM n), q AS MATERIALIZED (SELECT tbls, name, source_column, list_filter([{_DUCK_TAGS}], lambda x: x IS NOT NULL) AS tags FROM p),
g AS (SELECT name, source_column, tags, UNNEST(tbls) AS tbl FROM q)"""
_DUCK_PATTERN = "CASE WHEN contains(u, 'DELETE FROM') AND contains(u, 'INSERT INTO') THEN 'Delete and reload' WHEN contains(u, 'WHERE') AND (contains(u, 'LOAD_DATE') OR contains(u, 'UPDATED_AT')) THEN 'Timestamp-based incremental load' WHEN contains(u, 'MERGE INTO') THEN 'Merge/upsert' ELSE 'Full refresh' END"
_DUCK_WHEN = r"(?i)WHEN\s+(.+?)\s+THEN\s+(''[^'']*''|\w+)"
_DUCK_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) > 2))"
_WANTED = sorted({t for t in QUERY_TEXT.split() if len(t) > 2})

ORACLES = {
    "leaderboard_topk": "SELECT event_type AS name, ROUND(COUNT(*) FILTER (value > 50) / COUNT(*), 6) AS pass_rate, ROUND(COUNT(*) FILTER (value > 20) / COUNT(*), 6) AS token_f1 FROM events GROUP BY event_type ORDER BY pass_rate DESC, token_f1 DESC, name LIMIT 3",
    "sample_tables": "SELECT DATE '2024-01-01' + CAST(i AS INTEGER) AS load_date, i + 1 AS customer_id, CASE WHEN i > 0 THEN CAST(i * 10.5 AS DECIMAL(18,2)) END AS amount, 'name_' || i AS customer_name, 'v' || i AS note FROM range(5) t(i)",
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "join_anti": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "recon_row_count": "SELECT 'source' AS platform, COUNT(*) AS row_count FROM orders UNION ALL SELECT 'target', COUNT(*) FROM orders WHERE o_orderkey % 100 <> 0",
    "recon_distinct_count": f"WITH {_CHANGED} SELECT 'source' AS platform, COUNT(*) AS distinct_count FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) UNION ALL SELECT 'target', COUNT(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM changed)",
    "recon_null_rates": "SELECT 'user_id' AS column_name, COUNT(*) FILTER (user_id IS NULL) AS null_count, ROUND(COUNT(*) FILTER (user_id IS NULL) / COUNT(*), 4) AS null_rate FROM events UNION ALL SELECT 'event_type', COUNT(*) FILTER (event_type IS NULL), ROUND(COUNT(*) FILTER (event_type IS NULL) / COUNT(*), 4) FROM events UNION ALL SELECT 'value', COUNT(*) FILTER (event_type = 'error'), ROUND(COUNT(*) FILTER (event_type = 'error') / COUNT(*), 4) FROM events",
    "recon_sample_diff": "SELECT o_orderkey, 'source' AS only_in FROM orders WHERE o_orderkey % 100 = 0 ORDER BY 1, 2 LIMIT 100",
    "recon_metric_tolerance": f"WITH {_CHANGED}, v AS (SELECT 'rows' AS metric, CAST((SELECT COUNT(*) FROM orders) AS DOUBLE) AS source_value, CAST((SELECT COUNT(*) FROM changed) AS DOUBLE) AS target_value UNION ALL SELECT 'total', CAST((SELECT SUM(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS DOUBLE), CAST((SELECT SUM(CAST(o_totalprice AS DECIMAL(18,2))) FROM changed) AS DOUBLE) UNION ALL SELECT 'customers', CAST((SELECT COUNT(DISTINCT o_custkey) FROM orders) AS DOUBLE), CAST((SELECT COUNT(DISTINCT o_custkey) FROM changed) AS DOUBLE)) SELECT *, ABS(source_value - target_value) <= 0.001 * GREATEST(ABS(source_value), 1e-12) AS passed FROM v",
    "incr_delete_insert": "SELECT event_id, CAST(ts AS DATE) AS day, ROUND(CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-28' THEN value * 2 ELSE value END, 6) AS value FROM events",
    "incr_merge": "SELECT c_custkey, CASE WHEN c_custkey % 15 = 0 THEN UPPER(c_name) WHEN c_custkey % 5 = 0 THEN LOWER(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 15 = 0 THEN 2 WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS version FROM customer",
    "incr_watermark": "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' OR ts > (SELECT MAX(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00')",
    "script_temp_then_query": "SELECT o_custkey, day, order_count, CAST(s AS DOUBLE) AS total_spend, CASE WHEN order_count >= 2 AND s > 100 THEN 'MEDIUM_VALUE' ELSE 'STANDARD' END AS segment FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, COUNT(*) AS order_count, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1, 2)",
    "graph_out_degree": f"WITH {_DUCK_EDGES} SELECT src, COUNT(DISTINCT dst) AS n FROM edges GROUP BY src",
    "lineage_neighbors": f"WITH {_DUCK_EDGES}, u AS (SELECT dst AS node, STRING_AGG(DISTINCT src, ',' ORDER BY src) AS upstream FROM edges GROUP BY dst), w AS (SELECT src AS node, STRING_AGG(DISTINCT dst, ',' ORDER BY dst) AS downstream FROM edges GROUP BY src) SELECT node, COALESCE(upstream, '') AS upstream, COALESCE(downstream, '') AS downstream FROM u FULL JOIN w USING (node)",
    "graph_reachability": f"WITH RECURSIVE {_DUCK_EDGES}, walk AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS distance FROM region UNION SELECT start, dst, distance + 1 FROM walk JOIN edges ON node = src WHERE distance < 4) SELECT start, node, MIN(distance) AS distance FROM walk GROUP BY start, node",
    "graph_cycles": "WITH RECURSIVE e AS (SELECT n_nationkey AS src, CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 4 ELSE n_nationkey + 1 END AS dst FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey >= 20), walk AS (SELECT src AS start, dst AS node, 1 AS length FROM e UNION SELECT start, dst, length + 1 FROM walk JOIN e ON node = src WHERE length < 6) SELECT start AS node, MIN(length) AS length FROM walk WHERE start = node GROUP BY start",
    "graph_orphans": "SELECT 'c' || c_custkey AS node FROM customer UNION SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)",
    "classify_objects": f"WITH {_DUCK_OBJECTS}, u AS (SELECT *, upper(source_sql) AS u FROM objects) SELECT id, {_DUCK_TYPE} AS object_type, {_DUCK_NAME} AS name FROM u",
    "complexity_regex": f"WITH {_DUCK_OBJECTS} SELECT id, {', '.join(_duck_count('source_sql', p) + ' AS ' + n for n, p in assess.MEASURES)}, length(source_sql) - length(replace(source_sql, chr(10), '')) + 1 AS lines, length(source_sql) - length(replace(source_sql, ';', '')) + 1 AS statements FROM objects",
    "unsupported_features": f"WITH {_DUCK_OBJECTS}, u AS (SELECT *, upper(source_sql) AS u FROM objects) SELECT id, COALESCE(array_to_string({_DUCK_FEATURES}, ','), '') AS features FROM u",
    "risk_score": f"WITH {_DUCK_ASSESSED} SELECT id, object_type, score FROM a",
    "risk_bucket": f"WITH {_DUCK_ASSESSED} SELECT level, category, action, COUNT(*) AS n FROM a GROUP BY ALL",
    "rationalization": f"WITH {_DUCK_ASSESSED} SELECT CASE WHEN action = 'retire' OR category = 'retire' THEN 'retire' WHEN action IN ('manual_redesign', 'rewrite') THEN 'rewrite' WHEN action = 'review_and_migrate' THEN 'review' ELSE 'migrate' END AS action, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM a), 4) AS share FROM a GROUP BY 1",
    "scope_reduction": f"WITH {_DUCK_ASSESSED} SELECT COUNT(*) AS objects, COUNT(*) FILTER (action = 'retire' OR category = 'retire') AS retired, ROUND_EVEN(100.0 * COUNT(*) FILTER (action = 'retire' OR category = 'retire') / GREATEST(COUNT(*), 1), 0) AS percent FROM a",
    "table_columns": f"WITH {_DUCK_TABLE_LINEAGE} SELECT tbl AS table, source_column, COUNT(DISTINCT name) AS n_objects, COALESCE(array_to_string(list_sort(list_distinct(flatten(list(tags)))), ','), '') AS transforms FROM g GROUP BY tbl, source_column",
    "dashboard": f"WITH {_DUCK_ASSESSED} SELECT COUNT(*) AS total_objects, COUNT(*) FILTER (category = 'auto_migrate') AS auto_migratable, COUNT(*) FILTER (category = 'auto_with_review') AS requires_review, COUNT(*) FILTER (category IN ('manual_redesign', 'partial')) AS requires_redesign, COUNT(*) FILTER (category = 'retire') AS recommended_retirement, ROUND(AVG(score), 4) AS migration_risk_score FROM a",
    "lineage_edges": f"WITH {_DUCK_OBJECTS}, n AS (SELECT {_DUCK_NAME} AS name, {_DUCK_READS} AS r, {_DUCK_WRITES} AS w FROM objects), e AS (SELECT UNNEST(r) AS src, name AS dst, 'reads' AS relation FROM n UNION SELECT name, UNNEST(w), 'writes' FROM n) SELECT * FROM e WHERE src <> dst",
    "lineage_reads": f"WITH {_DUCK_OBJECTS} SELECT id, COALESCE(array_to_string({_DUCK_READS}, ','), '') AS reads, COALESCE(array_to_string({_DUCK_WRITES}, ','), '') AS writes FROM objects",
    "column_transforms": f"WITH {_DUCK_OBJECTS}, u AS (SELECT *, upper(source_sql) AS u FROM objects) SELECT id, COALESCE(array_to_string(list_filter([{', '.join(f'''CASE WHEN regexp_matches(u, '{p.replace('{c}', 'V')}') THEN '{n}' END''' for n, p in assess.TRANSFORMS)}], lambda x: x IS NOT NULL), ','), '') AS transforms FROM u",
    "business_rules": f"WITH {_DUCK_OBJECTS}, c AS (SELECT id, regexp_extract_all(source_sql, '(?is)CASE\\s+(.*?)\\s+END', 1)[1:10] AS cs FROM objects) SELECT id, COALESCE(array_to_string(flatten(list_transform(cs, lambda c: list_transform(list_zip(regexp_extract_all(c, '{_DUCK_WHEN}', 1), regexp_extract_all(c, '{_DUCK_WHEN}', 2)), lambda z: trim(z[1]) || ' -> ' || z[2]))), '; '), '') AS rules FROM c",
    "ddl_schema": f"WITH {_DUCK_OBJECTS}, b AS (SELECT UNNEST(regexp_extract_all(upper(source_sql), '{assess.DDL}', 1)) AS t, UNNEST(regexp_extract_all(upper(source_sql), '{assess.DDL}', 2)) AS body FROM objects), c AS (SELECT t, list_filter(list_zip(regexp_extract_all(body, '{assess.DDL_COLUMN}', 1), regexp_extract_all(body, '{assess.DDL_COLUMN}', 2)), lambda z: z[1] NOT IN {assess.CONSTRAINTS}) AS cs FROM b) SELECT t AS table, CAST(i AS INTEGER) AS position, cs[i + 1][1] AS column, cs[i + 1][2] AS type FROM (SELECT *, UNNEST(range(len(cs))) AS i FROM c)",
    "date_diff_units": "SELECT CAST(o_orderkey AS BIGINT) AS key, " + ", ".join(f"date_diff('{u}', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS {u}s" for u in ("year", "quarter", "month", "day")) + ", date_diff('day', date_trunc('week', CAST(o_orderdate AS DATE)), date_trunc('week', DATE '2001-08-01')) // 7 AS weeks, date_diff('hour', TIMESTAMP '2001-07-31 22:59:59', TIMESTAMP '2001-08-01 01:00:00') AS hours FROM orders",
    "to_char_format": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%m/%y') AS month, strftime(CAST(o_orderdate AS TIMESTAMP), '%H:%M:%S') AS time FROM orders",
    "date_trunc_units": "SELECT o_orderkey, " + ", ".join(f"CAST(date_trunc('{u}', o_orderdate) AS DATE) AS {u}" for u in ("year", "quarter", "month", "week")) + " FROM orders",
    "update_rewrite": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders",
    "behavior_differences": f"WITH {_DUCK_OBJECTS}, n AS (SELECT {_DUCK_NAME} AS name, source_sql FROM objects) SELECT name, behavior, severity FROM n, (VALUES {', '.join(f"('{n}', '{p}', '{v}')" for n, p, v in _vertica_rules())}) AS k(behavior, pattern, severity) WHERE regexp_matches(source_sql, '(?i)' || pattern) OR (behavior = 'default_ordering' AND len(list_filter(string_split(source_sql, chr(10)), lambda l: regexp_matches(regexp_replace(l, '(?i)^.*ORDER BY', ''), '(?i)SELECT'))) > 0)",
    "column_refs": f"WITH {_DUCK_OBJECTS} SELECT id, COALESCE(array_to_string({_DUCK_COLUMNS}, ','), '') AS columns FROM objects",
    "column_lineage": f"WITH {_DUCK_LINEAGE} SELECT name, source_column, col AS column, COALESCE(array_to_string(tags, ','), '') AS transforms FROM g",
    "column_usage": f"WITH {_DUCK_LINEAGE} SELECT source_column, COUNT(DISTINCT name) AS n_objects, COALESCE(array_to_string(list_sort(list_distinct(flatten(list(tags)))), ','), '') AS transforms FROM g GROUP BY source_column",
    "recon_value_diff": f"WITH {_CHANGED} SELECT o.o_orderkey, 1 AS n_source, CASE WHEN c.o_orderkey IS NULL THEN 0 ELSE 1 END AS n_target, CASE WHEN c.o_totalprice <> o.o_totalprice THEN 'o_totalprice' ELSE '' END AS changed FROM orders o LEFT JOIN changed c ON o.o_orderkey = c.o_orderkey WHERE c.o_orderkey IS NULL OR c.o_totalprice <> o.o_totalprice OR c.o_custkey <> o.o_custkey",
    "graph_upstream": f"WITH RECURSIVE {_DUCK_EDGES}, walk AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS distance FROM customer UNION SELECT start, src, distance + 1 FROM walk JOIN edges ON node = dst WHERE distance < 4) SELECT start, node, MIN(distance) AS distance FROM walk GROUP BY start, node",
    **{f"unsupported_features_{name}": f"WITH {_DUCK_OBJECTS}, u AS (SELECT *, upper(source_sql) AS u FROM objects) SELECT id, COALESCE(array_to_string({_duck_features(name)}, ','), '') AS features FROM u" for name in assess.FEATURES if name != "vertica"},
    "incr_strategy": f"WITH {_DUCK_OBJECTS}, u AS (SELECT *, upper(source_sql) AS u FROM objects), p AS (SELECT id, {_DUCK_PATTERN} AS pattern FROM u) SELECT *, CASE pattern WHEN 'Delete and reload' THEN 'delete+insert' WHEN 'Full refresh' THEN 'N/A' ELSE 'merge' END AS strategy FROM p",
    "text_stats": "SELECT doc_id, strlen(text) AS bytes, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, length(text) AS chars FROM documents",
    "token_count": f"SELECT doc_id, len({_DUCK_TOKENS.format(_DUCK_NORMAL.format('text'))}) AS n FROM documents",
    "text_normalize": f"SELECT doc_id, {_DUCK_NORMAL.format('text')} AS normal FROM documents",
    "eval_pairs_scored": f"WITH {_DUCK_EVAL} SELECT pair_id, exact_match, ROUND(token_f1, 6) AS token_f1, ROUND(fuzzy, 6) AS fuzzy, exact_match = 1 OR (token_f1 >= 0.85 AND fuzzy >= 0.75) AS passed FROM e",
    "eval_summary": f"WITH {_DUCK_EVAL} SELECT conv_id % 3 AS category, COUNT(*) AS n_pairs, ROUND(AVG(exact_match), 4) AS exact_match, ROUND(AVG(token_f1), 4) AS token_f1, ROUND(AVG(fuzzy), 4) AS fuzzy, ROUND(AVG(CAST(exact_match = 1 OR (token_f1 >= 0.85 AND fuzzy >= 0.75) AS DOUBLE)), 4) AS passed FROM e GROUP BY ROLLUP(conv_id % 3)",
    "keyword_topk": f"WITH d AS (SELECT doc_id, {_DUCK_TERMS} AS t FROM documents), s AS (SELECT doc_id, len(list_intersect(t, {_WANTED})) AS b, len(t) AS n FROM d) SELECT doc_id, ROUND(b / sqrt(n * CAST({len(_WANTED)} AS DOUBLE)), 6) AS score FROM s WHERE b > 0 ORDER BY score DESC, doc_id LIMIT 10",
    "embedding_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, ROUND(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10",
    "intent_route": f"SELECT {retrieval.intent_sql('p')} AS intent, COUNT(*) AS n FROM (SELECT lower(coalesce(text, '')) AS p FROM conversations) GROUP BY 1",
}
