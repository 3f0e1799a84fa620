"""Queries over sequences of rows, graphs and nested values, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.operators import cycles, patterns, semistructured, timeseries
from quarryflow.sources.tables import plain_sql, run_sql, table


def _matches(spark: SparkSession, folder: str, pattern: str, days: int, overlapping: bool = False) -> DataFrame:
    events, symbol = table(spark, folder, "events"), F.substring("event_type", 1, 1)
    found = patterns.match_rows(events, ["user_id"], "ts", ["event_id"], symbol, pattern, days * 86_400, ["event_id", "event_type", "value"], overlapping)
    money = lambda x: F.coalesce(x["value"].cast("decimal(18,4)"), F.lit(0)).cast("decimal(18,4)")
    total = F.aggregate("matched", F.lit(0).cast("decimal(28,4)"), lambda sum_, x: (sum_ + money(x)).cast("decimal(28,4)"))
    last = F.element_at("matched", -1)
    return found.select("user_id", F.col("matched")[0]["event_id"].alias("first_event"), last["event_id"].alias("last_event"), F.size("matched").cast("long").alias("events"), last["event_type"].alias("outcome"), total.cast("double").alias("total"))


def match_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """A view, then clicks, then a purchase or an error, all within a day."""
    return _matches(spark, folder, "vc+[pe]", 1)


def match_overlapping(spark: SparkSession, folder: str) -> DataFrame:
    """A view and the next purchase with at most six other events between, within three days; matches don't overlap."""
    return _matches(spark, folder, "v[^p]{0,6}p", 3)


def match_every_start(spark: SparkSession, folder: str) -> DataFrame:
    """The same from every view."""
    return _matches(spark, folder, "v[^p]{0,6}p", 3, overlapping=True)


def timeseries_slices(spark: SparkSession, folder: str) -> DataFrame:
    found = timeseries.slices(table(spark, folder, "events"), ["user_id"], "ts", ["event_id"], "value", 21_600)
    return found.select("user_id", "slice_us", "n", *(F.round(c, 6).alias(c) for c in ("first_const", "first_linear", "last_const", "last_linear")))


#: For each part the two parts that most often come on the next line of an order.
FOLLOWERS = """WITH pairs AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, COUNT(*) AS n, MAX(b.l_extendedprice) AS price
  FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey),
ranked AS (SELECT src, dst, ROW_NUMBER() OVER (PARTITION BY src ORDER BY n DESC, price DESC, dst) AS r FROM pairs)
SELECT src, dst FROM ranked WHERE r <= 2"""


def graph_elementary_cycles(spark: SparkSession, folder: str) -> DataFrame:
    found = cycles.elementary_cycles(run_sql(spark, folder, FOLLOWERS), 6)
    return found.select(F.array_join("cycle", ",").alias("cycle"), "length")


#: One JSON object an order, lines in order, made in both engines.
ORDER_JSON = """SELECT o_orderkey, to_json(named_struct('id', o_orderkey, 'status', o_orderstatus, 'urgent', o_orderpriority = '1-URGENT', 'buyer.info', named_struct('key', o_custkey, 'tags', array(o_orderpriority, o_orderstatus)),
  'lines', transform(sort_array(collect_list(struct(l_linenumber, l_partkey, l_quantity, l_returnflag))), x -> named_struct('n', x.l_linenumber, 'part', x.l_partkey, 'qty', CAST(x.l_quantity AS BIGINT), 'flags', array(x.l_returnflag))))) AS doc
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY ALL"""


def flatten_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Members of every order's JSON by path (any index) and kind, with what their texts hold."""
    docs = run_sql(spark, folder, ORDER_JSON.replace("GROUP BY ALL", "GROUP BY o_orderkey, o_orderstatus, o_orderpriority, o_custkey"))
    return semistructured.member_shapes(docs, "doc", "o_orderkey").withColumnRenamed("owners", "orders")


def flatten_props(spark: SparkSession, folder: str) -> DataFrame:
    """The members of every event's properties as a map of whole numbers, by type and key."""
    found = semistructured.map_members(table(spark, folder, "events"), "props", ["event_type"], "bigint")
    return found.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))


QUERIES = {
    "match_funnel": match_funnel,
    "match_overlapping": match_overlapping,
    "match_every_start": match_every_start,
    "timeseries_slices": timeseries_slices,
    "graph_elementary_cycles": graph_elementary_cycles,
    "flatten_orders": flatten_orders,
    "flatten_props": flatten_props,
}

_POSITIONS = "e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"
_TOTAL = "(SELECT CAST(SUM(COALESCE(CAST(x.value AS DECIMAL(18,4)), 0)) AS DOUBLE) FROM e x WHERE x.user_id = {0}.user_id AND x.pos BETWEEN {0}.s AND {0}.t)"
_PURCHASES = "c AS (SELECT v.user_id, v.pos AS s, MIN(p.pos) AS t FROM e v JOIN e p ON p.user_id = v.user_id AND p.pos BETWEEN v.pos + 1 AND v.pos + 7 AND p.ts <= v.ts + INTERVAL 3 DAY AND p.event_type = 'purchase' WHERE v.event_type = 'view' GROUP BY 1, 2)"
_NAMED = "SELECT k.user_id, a.event_id AS first_event, b.event_id AS last_event, k.t - k.s + 1 AS events, b.event_type AS outcome, " + _TOTAL.format("k") + " AS total FROM {0} k JOIN e a ON a.user_id = k.user_id AND a.pos = k.s JOIN e b ON b.user_id = k.user_id AND b.pos = k.t"

ORACLES = {
    "match_funnel": f"""WITH {_POSITIONS},
m AS (SELECT *, MAX(CASE WHEN event_type <> 'click' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
c AS (SELECT m.user_id, v.pos AS s, m.pos AS t FROM m JOIN e v ON v.user_id = m.user_id AND v.pos = m.before
  WHERE m.event_type IN ('purchase', 'error') AND v.event_type = 'view' AND m.pos - v.pos >= 2 AND m.ts <= v.ts + INTERVAL 1 DAY)
{_NAMED.format("c")}""",
    "match_overlapping": f"""WITH RECURSIVE {_POSITIONS}, {_PURCHASES},
n AS (SELECT a.user_id, a.s, a.t, MIN(b.s) AS after FROM c a LEFT JOIN c b ON b.user_id = a.user_id AND b.s > a.t GROUP BY 1, 2, 3),
pick AS (SELECT * FROM n WHERE s = (SELECT MIN(s) FROM n o WHERE o.user_id = n.user_id) UNION ALL SELECT n.* FROM pick JOIN n ON n.user_id = pick.user_id AND n.s = pick.after)
{_NAMED.format("pick")}""",
    "match_every_start": f"WITH {_POSITIONS}, {_PURCHASES} {_NAMED.format('c')}",
    "timeseries_slices": """WITH s AS (SELECT user_id, epoch_us(ts) // 21600000000 AS k, COUNT(value) AS n, FIRST(value ORDER BY ts, event_id) AS one, LAST(value ORDER BY ts, event_id) AS two, MIN(epoch_us(ts)) AS one_us, MAX(epoch_us(ts)) AS two_us FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
cal AS (SELECT user_id, UNNEST(range(lo, hi + 1)) AS k FROM (SELECT user_id, MIN(k) AS lo, MAX(k) AS hi FROM s GROUP BY 1)),
j AS (SELECT cal.user_id, cal.k, s.n, s.one, s.two, LAST_VALUE(two IGNORE NULLS) OVER b AS p, LAST_VALUE(two_us IGNORE NULLS) OVER b AS p_us, FIRST_VALUE(one IGNORE NULLS) OVER a AS q, FIRST_VALUE(one_us IGNORE NULLS) OVER a AS q_us
  FROM cal LEFT JOIN s ON s.user_id = cal.user_id AND s.k = cal.k
  WINDOW b AS (PARTITION BY cal.user_id ORDER BY cal.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY cal.user_id ORDER BY cal.k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, k * 21600000000 AS slice_us, COALESCE(n, 0) AS n, ROUND(COALESCE(one, p), 6) AS first_const, ROUND(COALESCE(one, p + (q - p) * (CAST(k * 21600000000 - p_us AS DOUBLE) / CAST(q_us - p_us AS DOUBLE))), 6) AS first_linear,
  ROUND(COALESCE(two, p), 6) AS last_const, ROUND(COALESCE(two, p + (q - p) * (CAST((k + 1) * 21600000000 - p_us AS DOUBLE) / CAST(q_us - p_us AS DOUBLE))), 6) AS last_linear FROM j""",
    "graph_elementary_cycles": f"""WITH RECURSIVE f AS ({plain_sql(FOLLOWERS)}),
walk AS (SELECT src AS start, [src, dst] AS path, dst AS here FROM f WHERE dst > src
  UNION ALL SELECT start, list_append(path, dst), dst FROM walk JOIN f ON src = here WHERE dst > start AND NOT list_contains(path, dst) AND len(path) < 6)
SELECT array_to_string(path, ',') AS cycle, len(path) AS length FROM walk JOIN f ON src = here AND dst = start""",
    "flatten_orders": """WITH d AS (SELECT o_orderkey, json_object('id', o_orderkey, 'status', o_orderstatus, 'urgent', o_orderpriority = '1-URGENT', 'buyer.info', json_object('key', o_custkey, 'tags', json_array(o_orderpriority, o_orderstatus)),
  'lines', list(json_object('n', l_linenumber, 'part', l_partkey, 'qty', CAST(l_quantity AS BIGINT), 'flags', json_array(l_returnflag)) ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag)) AS doc
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority, o_custkey),
t AS (SELECT o_orderkey, regexp_replace(fullkey, '\\[\\d+\\]', '[*]', 'g') AS shape, CASE type WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE type END AS kind, atom ->> '$' AS text, CASE WHEN right(fullkey, 1) = ']' THEN CAST(key AS BIGINT) END AS idx FROM d, json_tree(doc) WHERE fullkey <> '$')
SELECT shape, kind, COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS orders, COUNT(DISTINCT text) AS texts, MAX(idx) AS last_index, MIN(text) AS least, CAST(SUM(LENGTH(text)) AS BIGINT) AS letters FROM t GROUP BY 1, 2""",
    "flatten_props": "SELECT event_type, j.key AS key, COUNT(*) AS n, CAST(SUM(CAST(j.value AS BIGINT)) AS BIGINT) AS total, MAX(CAST(j.value AS BIGINT)) AS most FROM events, json_each(props) j GROUP BY 1, 2",
}
