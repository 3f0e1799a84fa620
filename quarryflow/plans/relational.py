"""Relational queries: one entry an operator, as SQL that Catalyst plans.

Tables stand in braces. Where DuckDB spells something differently, OTHER has its text. Money is summed as DECIMAL, and
ranks are BIGINT, so that both engines give the same values and types.
"""

from __future__ import annotations

SQL: dict[str, str] = {
    # projection and filters
    "scan_project": "SELECT o_orderkey, o_custkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS doubled FROM {orders}",
    "select_star": "SELECT * FROM {nation}",
    "star_and_expr": "SELECT n.*, n_nationkey + 100 AS shifted FROM {nation} n",
    "derived_table": "SELECT s.seg, s.n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM {customer} GROUP BY c_mktsegment) s WHERE s.n > 1",
    "scalar_select": "SELECT 1 AS one, 'x' AS word, TRUE AS yes, CAST(NULL AS INT) AS nothing, 2 + 3 * 4 AS total",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "group_no_agg": "SELECT l_returnflag, l_linestatus FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "filter_compound": "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE (l_quantity > 45 AND NOT l_returnflag = 'N') OR (l_discount >= 0.09 AND l_tax < 0.02 AND l_linestatus <> 'O')",
    "null_predicates": "SELECT a, COUNT(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS a FROM {events}) t WHERE a IS NOT NULL OR a IS NULL GROUP BY a",
    "in_list": "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')",
    "in_subquery": "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)",
    "exists_subquery": "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 50)",
    "not_exists": "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)",
    "like_pattern": "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%'",
    "ilike_pattern": "SELECT p_partkey, p_type FROM {part} WHERE p_type ILIKE '%STEEL%' OR p_brand ILIKE 'brand#1_'",
    "between": "SELECT p_partkey, p_size FROM {part} WHERE p_size BETWEEN 10 AND 20",
    "having": "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 12",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "join_left": "SELECT o_orderkey, l_linenumber FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey AND l_linenumber = 1",
    "join_right": "SELECT l_orderkey, o_orderkey FROM (SELECT * FROM {lineitem} WHERE l_quantity > 49) l RIGHT JOIN {orders} ON l_orderkey = o_orderkey",
    "join_full": "SELECT a.k AS left_key, b.k AS right_key FROM (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey > 9) b ON a.k = b.k",
    "join_using": "SELECT k, a.v AS v1, b.v AS v2 FROM (SELECT c_nationkey AS k, COUNT(*) AS v FROM {customer} GROUP BY c_nationkey) a JOIN (SELECT s_nationkey AS k, COUNT(*) AS v FROM {supplier} GROUP BY s_nationkey) b USING (k)",
    "join_cross": "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}",
    "join_compound": "SELECT a.l_orderkey, a.l_partkey FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber",
    "join_theta": "SELECT a.p_size AS small, b.p_size AS large FROM (SELECT DISTINCT p_size FROM {part} WHERE p_size < 10) a JOIN (SELECT DISTINCT p_size FROM {part} WHERE p_size < 12) b ON a.p_size < b.p_size",
    "join_multi": "SELECT r_name, n_name, COUNT(*) AS n FROM {region} JOIN {nation} ON r_regionkey = n_regionkey JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey GROUP BY r_name, n_name",
    "join_self": "SELECT a.n_name AS first, b.n_name AS second FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    # aggregation
    "group_agg": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*), 4) AS mean_price, MIN(l_discount) AS least, MAX(l_tax) AS most FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "global_agg": "SELECT COUNT(*) AS n, COUNT(o_custkey) AS with_customer, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, MIN(o_orderdate) AS first, MAX(o_orderdate) AS last FROM {orders}",
    "count_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM {events} GROUP BY event_type",
    "agg_expr": "SELECT user_id, CAST(SUM(COALESCE(CAST(value AS DECIMAL(18,4)), 0)) AS DOUBLE) AS total FROM {events} GROUP BY user_id",
    "agg_post_expr": "SELECT o_custkey, CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 0) - COALESCE(MIN(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS rest FROM {orders} GROUP BY o_custkey",
    "string_agg": "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    "group_ordinal": "SELECT o_orderstatus, COUNT(*) AS n FROM {orders} GROUP BY 1",
    "group_expr": "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM {orders} GROUP BY YEAR(o_orderdate)",
    "rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM {lineitem} GROUP BY ROLLUP(l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY CUBE(l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, CAST(GROUPING(o_orderstatus) AS BIGINT) AS g FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "stats_agg": "SELECT o_orderpriority, ROUND(STDDEV_SAMP(o_totalprice), 2) AS sd, ROUND(VAR_POP(o_totalprice) / 1e6, 2) AS var_millions, ROUND(MEDIAN(o_totalprice), 4) AS med FROM {orders} GROUP BY o_orderpriority",
    # windows
    "win_running_sum": "SELECT o_custkey, o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM {orders}",
    "win_row_number": "SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS rn FROM {orders}",
    "win_topn_per_group": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM {orders}) t WHERE rn <= 2",
    "win_rank": "SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr FROM {part}",
    "win_lag_lead": "SELECT event_id, LAG(event_id) OVER w AS before, LEAD(event_id) OVER w AS after, FIRST_VALUE(event_id) OVER w AS first FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_ntile": "SELECT c_custkey, CAST(NTILE(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter FROM {customer}",
    "win_moving_avg": "SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM {events}",
    "win_range_frame": "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM {part}",
    # order, limit, sets
    "order_limit": "SELECT c_custkey, c_mktsegment, c_acctbal FROM {customer} ORDER BY c_mktsegment ASC, c_acctbal DESC NULLS LAST, c_custkey LIMIT 25",
    "topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT s_suppkey, s_acctbal FROM {supplier} ORDER BY s_acctbal, s_suppkey LIMIT 10 OFFSET 5",
    "oracle_rownum": "SELECT o_orderkey, rn FROM (SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY o_orderkey) AS BIGINT) AS rn FROM (SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 20) t) u",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
    "except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000",
    "union_order_limit": "SELECT k, kind FROM (SELECT c_custkey AS k, 'c' AS kind FROM {customer} UNION ALL SELECT s_suppkey, 's' FROM {supplier}) t ORDER BY k, kind LIMIT 15",
    # expressions
    "arith": "SELECT l_orderkey, l_linenumber, (l_extendedprice * (1 - l_discount)) / (1 + l_tax) - 3 AS v, l_linenumber / 2 AS half, l_linenumber % 3 AS rest FROM {lineitem}",
    "date_arith": "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 3 AS before, CAST(o_orderdate AS DATE) + 30 AS after FROM {orders}",
    "null_functions": "SELECT event_id, COALESCE(NULLIF(value, 0), -1) AS a, COALESCE(NULLIF(event_type, 'view'), 'none') AS b, CASE WHEN NULLIF(event_type, 'click') IS NOT NULL THEN 1 ELSE 0 END AS c FROM {events}",
    "iff": "SELECT o_orderkey, IF(o_totalprice > 100000, 'big', 'small') AS size FROM {orders}",
    "greatest_least": "SELECT p_partkey, GREATEST(p_size, 10, 25) AS g, LEAST(p_size, 10, 25) AS l FROM {part}",
    "string_case": "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n FROM {customer}",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'A' WHEN o_totalprice > 150000 THEN 'B' WHEN o_totalprice > 50000 THEN 'C' ELSE 'D' END AS band FROM {orders}",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'pending' END AS state FROM {orders}",
    "cast": "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS d, CAST(o_orderdate AS DATE) AS day FROM {orders}",
    "try_cast": "SELECT event_type, TRY_CAST(CASE WHEN event_type = 'view' THEN '12' ELSE event_type END AS INT) AS v, COUNT(*) AS n FROM {events} GROUP BY 1, 2",
    "date_diff": "SELECT l_orderkey, l_linenumber, DATEDIFF(DAY, CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "date_trunc": "SELECT CAST(DATE_TRUNC('MONTH', o_orderdate) AS DATE) AS m, COUNT(*) AS n FROM {orders} GROUP BY 1",
    "decode": "SELECT o_orderkey, DECODE(o_orderstatus, 'F', 1, 'O', 2, 0) AS code FROM {orders}",
    "empty_string_norm": "SELECT COALESCE(NULLIF(TRIM(t), ''), 'missing') AS v, COUNT(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN '  ' ELSE event_type END AS t FROM {events}) x GROUP BY 1",
    "json_extract": "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}",
    "explode_array": "SELECT doc_id, word FROM (SELECT doc_id, EXPLODE(SPLIT(source, 'c')) AS word FROM {documents}) t",
    "nvl2_zeroifnull": "SELECT event_id, NVL2(NULLIF(event_type, 'view'), 'other', 'view') AS a, ZEROIFNULL(NULLIF(value, value)) AS z, NVL(NULLIF(event_type, 'click'), 'c') AS b FROM {events}",
    "to_char": "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS c, DATE_FORMAT(o_orderdate, 'yyyy-MM-dd') AS d FROM {orders}",
    "scalar_now": "SELECT CURRENT_DATE = CAST(CURRENT_TIMESTAMP AS DATE) AS same_day, CURRENT_TIMESTAMP IS NOT NULL AS now",
    "event_sessions": "SELECT user_id, COUNT(*) AS sessions, CAST(SUM(n) AS BIGINT) AS events FROM (SELECT user_id, session_window.start AS s, COUNT(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '1 hour')) t GROUP BY user_id",
    # subqueries, scripts
    "cte_chain": "WITH big AS (SELECT o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 100000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN {customer} ON o_custkey = c_custkey WHERE n >= 3",
    "scalar_subquery": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.5 * AVG(o_totalprice) FROM {orders})",
    "correlated_subquery": "SELECT o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)",
    "recursive_hierarchy": "WITH RECURSIVE e AS (SELECT CONCAT('r', n_regionkey) AS parent, CONCAT('n', n_nationkey) AS child FROM {nation} UNION ALL SELECT CONCAT('n', c_nationkey), CONCAT('c', c_custkey) FROM {customer}), t(node, root, depth) AS (SELECT CONCAT('r', r_regionkey) AS node, r_name AS root, 0 AS depth FROM {region} UNION ALL SELECT child, root, depth + 1 FROM t JOIN e ON parent = node) SELECT node, root, depth FROM t",
    # workload of the migration corpus
    "clv": """WITH txns AS (SELECT o_custkey AS customer_id, o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
    CAST(l_extendedprice AS DECIMAL(18,4)) - COALESCE(NULLIF(CAST(l_extendedprice * l_discount AS DECIMAL(18,4)), 0), 0) AS net_amount,
    CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,4)) ELSE 0 END AS refund
  FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - 365),
per_order AS (SELECT customer_id, order_id, SUM(net_amount) AS net_amount, SUM(refund) AS refund, MAX(order_date) AS order_date FROM txns GROUP BY customer_id, order_id),
summ AS (SELECT customer_id, COUNT(*) AS order_count, SUM(net_amount) AS gross_spend, SUM(refund) AS total_refunds,
    SUM(net_amount) - SUM(refund) AS net_spend, MAX(order_date) AS last_order_date, MIN(order_date) AS first_order_date
  FROM per_order GROUP BY customer_id)
SELECT s.customer_id, c.c_name, order_count, CAST(gross_spend AS DOUBLE) AS gross_spend, CAST(total_refunds AS DOUBLE) AS total_refunds,
  CAST(net_spend AS DOUBLE) AS clv,
  CASE WHEN order_count >= 4 AND net_spend > 100000 THEN 'PLATINUM' WHEN order_count >= 3 AND net_spend > 50000 THEN 'GOLD'
       WHEN order_count >= 2 THEN 'SILVER' ELSE 'BRONZE' END AS loyalty_tier,
  last_order_date, DATEDIFF(DAY, first_order_date, last_order_date) AS lifespan_days
FROM summ s JOIN {customer} c ON s.customer_id = c.c_custkey""",
    "metrics_view": """WITH daily AS (SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS activity_date, COUNT(DISTINCT o_orderkey) AS order_count,
    SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total_spend FROM {orders} GROUP BY 1, 2)
SELECT customer_id, activity_date, order_count, CAST(total_spend AS DOUBLE) AS total_spend,
  CAST(SUM(total_spend) OVER (PARTITION BY customer_id ORDER BY activity_date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS lifetime_value,
  CAST(ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY activity_date DESC) AS BIGINT) AS recency_rank
FROM daily""",
    "proc_customer_daily": """WITH tmp_customer_txns AS (SELECT o_custkey AS customer_id, o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
    CAST(l_extendedprice AS DECIMAL(18,4)) - COALESCE(NULLIF(CAST(l_extendedprice * l_discount AS DECIMAL(18,4)), 0), 0) AS net_amount
  FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'),
tmp_customer_daily AS (SELECT customer_id, DATE '1998-10-03' AS activity_date, COUNT(DISTINCT order_id) AS order_count,
    SUM(net_amount) AS total_spend, MAX(order_date) AS last_order_date FROM tmp_customer_txns GROUP BY customer_id)
SELECT customer_id, activity_date, order_count, CAST(total_spend AS DOUBLE) AS total_spend, last_order_date,
  CASE WHEN order_count >= 5 AND last_order_date >= DATE '1998-10-03' - 90 AND total_spend > 500 THEN 'HIGH_VALUE'
       WHEN order_count >= 2 AND total_spend > 100 THEN 'MEDIUM_VALUE' ELSE 'STANDARD' END AS customer_segment,
  CASE WHEN order_count = 1 THEN 'NEW' WHEN last_order_date >= DATE '1998-10-03' - 30 THEN 'ACTIVE' ELSE 'DORMANT' END AS activity_status
FROM tmp_customer_daily""",
    "churn": """WITH ev AS (SELECT user_id, ts, event_type, CAST(COALESCE(value, 0) AS DECIMAL(18,4)) AS event_value FROM {events}
  WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 20),
ua AS (SELECT user_id, COUNT(*) AS event_count, COUNT(DISTINCT event_type) AS event_type_nunique,
    CAST(SUM(event_value) AS DOUBLE) AS value_sum, ROUND(CAST(SUM(event_value) AS DOUBLE) / COUNT(*), 6) AS value_avg,
    DATEDIFF(DAY, CAST(MAX(ts) AS DATE), DATE '2024-01-31') AS days_since_last_event FROM ev GROUP BY user_id),
lb AS (SELECT user_id, CASE WHEN COALESCE(SUM(CASE WHEN event_type = 'error' THEN 1 END), 0) > 14 THEN 1 ELSE 0 END AS churn_label
  FROM {events} GROUP BY user_id)
SELECT ua.*, churn_label FROM ua JOIN lb ON ua.user_id = lb.user_id""",
    "gap_fill_daily": """WITH days AS (SELECT EXPLODE(SEQUENCE(DATE '2023-12-15', DATE '2024-02-14')) AS day),
per AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY 1)
SELECT days.day, COALESCE(n, 0) AS n FROM days LEFT JOIN per ON days.day = per.day""",
    "event_windows": "SELECT CAST(window.start AS DATE) AS day, event_type, COUNT(*) AS n FROM {events} GROUP BY window(ts, '1 day'), event_type",
}

#: Where DuckDB needs other words.
OTHER: dict[str, str] = {
    "to_char": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS c, STRFTIME(o_orderdate, '%Y-%m-%d') AS d FROM orders",
    "scalar_now": "SELECT TRUE AS same_day, TRUE AS now",
    "event_sessions": "SELECT user_id, CAST(SUM(fresh) AS BIGINT) AS sessions, COUNT(*) AS events FROM (SELECT user_id, CASE WHEN ts >= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR OR LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events) GROUP BY user_id",
    "string_agg": "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "iff": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders",
    "decode": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders",
    "json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "explode_array": "SELECT doc_id, UNNEST(string_split(source, 'c')) AS word FROM documents",
    "nvl2_zeroifnull": "SELECT event_id, CASE WHEN NULLIF(event_type, 'view') IS NOT NULL THEN 'other' ELSE 'view' END AS a, COALESCE(NULLIF(value, value), 0) AS z, COALESCE(NULLIF(event_type, 'click'), 'c') AS b FROM events",
    "date_trunc": "SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS m, COUNT(*) AS n FROM orders GROUP BY 1",
    "gap_fill_daily": "SELECT CAST(d.day AS DATE) AS day, COUNT(e.event_id) AS n FROM (SELECT UNNEST(generate_series(DATE '2023-12-15', DATE '2024-02-14', INTERVAL 1 DAY)) AS day) d LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(d.day AS DATE) AND event_type = 'error' GROUP BY 1",
    "event_windows": "SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2",
    "cast": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS d, CAST(o_orderdate AS DATE) AS day FROM orders",
}
for _name in ("date_diff", "clv", "churn"):
    OTHER[_name] = SQL[_name].replace("DATEDIFF(DAY,", "DATEDIFF('day',")
