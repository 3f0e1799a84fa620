"""Queries that write and read back tables, reconcile, sketch and join ranges, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.operators import filetable, hashtree, intervals, patterns, sketches
from quarryflow.plans.analysis import ORACLES as ANALYSIS
from quarryflow.plans.analysis import changed_orders
from quarryflow.sources.scratch import fresh_folder
from quarryflow.sources.tables import run_sql, table
from quarryflow.streaming import increments, upserts

#: An increment of orders: those of the last thirty days with another total, and the last five days' once more under new keys.
INCREMENT = """SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, o_orderdate FROM {orders} WHERE o_orderdate >= (SELECT MAX(o_orderdate) - INTERVAL '30' DAY FROM {orders})
UNION ALL SELECT -1 - o_orderkey, o_custkey, o_totalprice, o_orderdate FROM {orders} WHERE o_orderdate >= (SELECT MAX(o_orderdate) - INTERVAL '5' DAY FROM {orders})"""


def merge_rewrite_files(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in files by date: an increment merged, small totals raised, one customer in eight's cheap orders deleted."""
    path = fresh_folder(spark, "orders")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    orders.repartitionByRange(8, "o_orderdate").write.parquet(path)
    filetable.merge_files(spark, path, run_sql(spark, folder, INCREMENT), ["o_orderkey"], ["o_orderdate"])
    filetable.update_files(spark, path, F.col("o_totalprice") < 2000, {"o_totalprice": F.col("o_totalprice") * 2})
    filetable.delete_files(spark, path, (F.col("o_custkey") % 8 == 0) & (F.col("o_totalprice") < 10_000))
    return filetable.read(spark, path)


def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The newest event of each user and type, kept by a stream that stops and goes on from its checkpoint three times."""
    base = fresh_folder(spark, "stream")
    events = table(spark, folder, "events").select("user_id", "event_type", "event_id", "ts", "value")
    kinds = [r["event_type"] for r in events.select("event_type").distinct().orderBy("event_type").limit(3).collect()]  # how the files come to be
    late = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("event_type")), F.lit(0)) if kinds else F.lit(0)
    for k in range(max(1, len(kinds) + 1)):
        events.where(late == k).write.mode("append").parquet(f"{base}/in")
        stream = increments.read_files(spark, f"{base}/in", events.schema, files_a_batch=2)
        upserts.upsert(stream, f"{base}/table", ["user_id", "event_type"], ["ts", "event_id"], f"{base}/checkpoint").awaitTermination()
    return filetable.read(spark, f"{base}/table", events.schema).select("user_id", "event_type", "event_id", "value")


def recon_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    return hashtree.tree_diff(table(spark, folder, "orders"), changed_orders(spark, folder), ["o_orderkey"], ["o_custkey", "o_totalprice"])


def _texts(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"), "o_orderstatus")


def recon_tree_levels(spark: SparkSession, folder: str) -> DataFrame:
    """How many buckets of each level of both sides' trees differ, and the rows in them."""
    trees = [hashtree.tree(_texts(df), ["o_orderkey"], ["o_custkey", "total", "o_orderstatus"], 3) for df in (table(spark, folder, "orders"), changed_orders(spark, folder))]
    found = hashtree.drilled(*trees, 3)
    return found.groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("differing"), F.sum("n_source").alias("n_source"), F.sum("n_target").alias("n_target"), F.min("bucket").alias("first"))


def recon_checksum_md5(spark: SparkSession, folder: str) -> DataFrame:
    return hashtree.checksum(_texts(table(spark, folder, "orders")), ["o_orderkey", "o_custkey", "total", "o_orderstatus"])


def interval_join(spark: SparkSession, folder: str) -> DataFrame:
    """For each purchase the errors at most six hours before or after it, of anyone: how many, and how near."""
    events = table(spark, folder, "events")
    us, reach = patterns.micros(events, "ts"), 6 * 3_600_000_000
    of = lambda kind: events.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), us.alias("at"))
    near = intervals.points_within(of("purchase"), of("error"), reach, reach, parts=8)
    return near.select(F.col("id").alias("event_id"), F.col("n").alias("errors"), F.col("nearest").alias("nearest_us"), F.col("first").alias("first_error"))


def sketch_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct orders and price quantiles by flag, from sketches by flag and month: exact counts, and whether the estimates are within their bounds."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_orderkey", "l_extendedprice", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"))
    fine = sketches.make(lines, ["l_returnflag", "month"], "l_orderkey", "l_extendedprice")
    guess = sketches.estimates(sketches.roll_up(fine, ["l_returnflag"]), ["l_returnflag"])
    guess = guess.select(F.col("l_returnflag").alias("flag"), "distinct", "q50", "q90")  # a few flags
    below = lambda c: F.sum(F.when(F.col("l_extendedprice") <= F.col(c), 1).otherwise(0)) / F.count("*")
    exact = lines.join(F.broadcast(guess), F.col("l_returnflag") == F.col("flag")).groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.countDistinct("l_orderkey").alias("orders"), F.first("distinct").alias("_d"), below("q50").alias("_50"), below("q90").alias("_90"))
    error = 3 * 1.04 / 2 ** (sketches.LOG_K / 2)
    return exact.select("l_returnflag", "lines", "orders", (F.abs(F.col("_d") - F.col("orders")) <= error * F.col("orders") + 1).alias("distinct_ok"), ((F.abs(F.col("_50") - 0.5) < 0.02) & (F.abs(F.col("_90") - 0.9) < 0.02)).alias("quantiles_ok"))


QUERIES = {
    "merge_rewrite_files": merge_rewrite_files,
    "stream_upsert": stream_upsert,
    "recon_hash_tree": recon_hash_tree,
    "recon_tree_levels": recon_tree_levels,
    "recon_checksum_md5": recon_checksum_md5,
    "interval_join": interval_join,
    "sketch_rollup": sketch_rollup,
}

_KEY = "'=' || CAST(o_orderkey AS VARCHAR)"
_TEXT = _KEY + " || chr(31) || '=' || CAST(o_custkey AS VARCHAR) || chr(31) || '=' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || chr(31) || '=' || o_orderstatus"
_NUMBER = f"CAST('0x' || substr(md5({_TEXT}), 1, 15) AS BIGINT)"
_CHANGED = "SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 100 <> 0"

ORACLES = {
    "merge_rewrite_files": """WITH last AS (SELECT MAX(o_orderdate) AS d FROM orders),
merged AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= d - INTERVAL 30 DAY THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders, last
  UNION ALL SELECT -1 - o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders, last WHERE o_orderdate >= d - INTERVAL 5 DAY),
raised AS (SELECT * REPLACE (CASE WHEN o_totalprice < 2000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice) FROM merged)
SELECT * FROM raised WHERE NOT (o_custkey % 8 = 0 AND o_totalprice < 10000)""",
    "stream_upsert": "SELECT user_id, event_type, event_id, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "recon_hash_tree": ANALYSIS["recon_value_diff"],
    "recon_tree_levels": f"""WITH s AS (SELECT md5({_KEY}) AS h, {_NUMBER} AS v FROM orders), t AS (SELECT md5({_KEY}) AS h, {_NUMBER} AS v FROM ({_CHANGED})),
l AS (SELECT UNNEST([1, 2, 3]) AS level),
a AS (SELECT level, substr(h, 1, level) AS bucket, COUNT(*) AS n, SUM(v) AS total FROM s, l GROUP BY 1, 2), b AS (SELECT level, substr(h, 1, level) AS bucket, COUNT(*) AS n, SUM(v) AS total FROM t, l GROUP BY 1, 2)
SELECT CAST(level AS BIGINT) AS level, COUNT(*) AS differing, CAST(SUM(COALESCE(a.n, 0)) AS BIGINT) AS n_source, CAST(SUM(COALESCE(b.n, 0)) AS BIGINT) AS n_target, MIN(bucket) AS first
FROM a FULL JOIN b USING (level, bucket) WHERE a.n IS DISTINCT FROM b.n OR a.total IS DISTINCT FROM b.total GROUP BY 1""",
    "recon_checksum_md5": f"SELECT COUNT(*) AS row_count, CAST(SUM({_NUMBER}) AS VARCHAR) AS checksum FROM orders",
    "interval_join": """SELECT p.event_id, COUNT(*) AS errors, MIN(ABS(epoch_us(p.ts) - epoch_us(e.ts))) AS nearest_us, MIN(e.event_id) AS first_error
FROM events p JOIN events e ON e.ts >= p.ts - INTERVAL 6 HOUR AND e.ts <= p.ts + INTERVAL 6 HOUR WHERE p.event_type = 'purchase' AND e.event_type = 'error' GROUP BY 1""",
    "sketch_rollup": "SELECT l_returnflag, COUNT(*) AS lines, COUNT(DISTINCT l_orderkey) AS orders, TRUE AS distinct_ok, TRUE AS quantiles_ok FROM lineitem GROUP BY 1",
}
