"""Texts of SQL objects, made from rows of a table by the same SQL expression in both engines.

Each shape is a text with places for the row's columns; the row's key chooses the shape, so every part gets an object.
"""

from __future__ import annotations

import re

#: Columns that stand in a shape's places.
PLACES = {"id": "CAST(p_partkey AS STRING)", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "CAST(p_size AS STRING)"}

#: Long bodies, from a rule.
_JOINS = "\n".join(f"LEFT JOIN dim.d{i} d{i} ON f.k{i} = d{i}.k" for i in range(32))
_CTES = "\n".join(f"INSERT INTO work.w_<id> WITH c{i} AS (SELECT k FROM raw.r{i}) SELECT k FROM c{i};" for i in range(21))
_NESTED = " UNION ALL ".join(f"SELECT k FROM (SELECT k, MAX(v) AS v FROM raw.n{i} GROUP BY k) n{i}" for i in range(16))
_WINDOWS = ",\n".join(f"SUM(m{i}) OVER (PARTITION BY k ORDER BY t) AS s{i}" for i in range(12))
_CASES = ", ".join(f"CASE WHEN f.a{i} > {i} THEN 'over {i}' ELSE 'under' END AS b{i}" for i in range(7))
_LINES = "\n".join(f"  v{i} := v{i} + 1;" for i in range(520))
_TEMPS = "\n".join(f"CREATE LOCAL TEMP TABLE t{i} AS SELECT k FROM raw.t{i};" for i in range(6))

SHAPES = (
    "CREATE OR REPLACE VIEW rpt.part_<id> AS\nWITH base AS (SELECT p.k, p.name FROM raw.parts p WHERE p.brand = '<brand>'),\n sized AS (SELECT b.k, COUNT(*) AS n FROM base b GROUP BY b.k)\nSELECT s.k, s.n FROM sized s JOIN raw.stock t ON s.k = t.k",
    "CREATE VIEW rpt.wide_<id> AS SELECT f.k, " + _CASES + " FROM mart.facts f\n" + _JOINS,
    "CREATE VIEW rpt.roll_<id> AS SELECT k,\n" + _WINDOWS + "\nFROM mart.daily",
    "CREATE VIEW rpt.deep_<id> AS " + _NESTED,
    "-- loads of <name>\n" + _CTES,
    "CREATE PROCEDURE etl.all_<id> AS BEGIN\n  DECLARE CURSOR c1;\n  EXECUTE IMMEDIATE 'TRUNCATE TABLE work.x';\n  INSERT INTO mart.all_<id> SELECT f.k, " + _CASES + " FROM mart.facts f\n" + _JOINS + ";\n" + _LINES + "\nEND",
    "CREATE PROCEDURE etl.temps_<id> AS BEGIN\n" + _TEMPS + "\nINSERT INTO mart.temps SELECT k FROM t0;\nEND",
    "/* <name>, <brand>:\n   don't drop; FROM here it's a comment */\nCREATE TABLE mart.c_<id> (k INT NOT NULL, label VARCHAR(<size>) DEFAULT 'none', price DECIMAL(18,2), CONSTRAINT pk_<id> PRIMARY KEY (k))",
    "CREATE TABLE mart.keys_<id> (a INT, b DATE, PRIMARY KEY (a), UNIQUE (b), FOREIGN KEY (a) REFERENCES mart.parts (k), CHECK (a > 0))",
    "CREATE TABLE work.one_<id> (k INT, v FLOAT);\nCREATE TABLE work.two_<id> (k INT, w VARCHAR(20), at TIMESTAMP);\nINSERT INTO work.two_<id> SELECT o.k, 'x', CURRENT_TIMESTAMP FROM work.one_<id> o",
    "CREATE TABLE mart.seg_<id> (k INT ENCODING RLE, v NUMERIC(12,4)) ORDER BY k SEGMENTED BY HASH(k) ALL NODES KSAFE 1",
    "CREATE PROJECTION mart.p_<id> AS SELECT k, v FROM mart.seg_<id> ORDER BY k SEGMENTED BY HASH(k) ALL NODES",
    "SELECT slice_time, TS_FIRST_VALUE(v, 'LINEAR') FROM raw.ticks TIMESERIES slice_time AS '1 minute' OVER (PARTITION BY k ORDER BY at)",
    "SELECT LEVEL, e.k, e.boss FROM hr.staff e START WITH e.boss IS NULL CONNECT BY PRIOR e.k = e.boss",
    "SELECT * FROM (SELECT o.k, o.v FROM sales.orders o ORDER BY o.v DESC) q WHERE ROWNUM <= <size>",
    "SELECT sales.order_seq.NEXTVAL FROM DUAL",
    "CREATE OR REPLACE PACKAGE etl.pkg_<id> AS PROCEDURE run; END;",
    "BEGIN UPDATE sales.stock SET qty = 0 WHERE name = ''; EXCEPTION WHEN NO_DATA_FOUND THEN NULL; END;",
    "CREATE TABLE dw.r_<id> (k INT, doc SUPER) DISTSTYLE KEY DISTKEY (k) COMPOUND SORTKEY (k)",
    "CREATE EXTERNAL SCHEMA lake_<id> FROM DATA CATALOG DATABASE 'lake'; SELECT k FROM spectrum.logs WHERE updated_at > '2024-01-01'",
    "SELECT k, LISTAGG(name, ',') WITHIN GROUP (ORDER BY name) AS names FROM dw.people GROUP BY k",
    "DECLARE total INT64; SELECT k, ARRAY<STRING>['<type>'] AS tags FROM ds.parts QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY at DESC) = 1",
    "SELECT SAFE.DIVIDE(a, b) AS ratio, STRUCT<x INT64, y INT64>(1, 2) AS pt FROM ds.points, UNNEST(tags) AS tag",
    "CREATE TABLE raw.events_<id> (payload VARIANT, at TIMESTAMP_TZ); SELECT f.value FROM raw.events_<id> e, LATERAL FLATTEN(input => e.payload) f",
    "SELECT * FROM raw.ticks MATCH_RECOGNIZE (PARTITION BY sym ORDER BY at MEASURES FIRST(a.p) AS p0 PATTERN (a b+) DEFINE b AS b.p > a.p)",
    "CREATE OR REPLACE PROCEDURE util.js_<id>() RETURNS STRING LANGUAGE JAVASCRIPT AS 'return \"<name>\";'",
    "CREATE FUNCTION util.net_<id>(x FLOAT) RETURN FLOAT AS BEGIN RETURN x / 1.2; END",
    "CREATE OR REPLACE FUNCTION util.band_<id>(x INT) RETURN VARCHAR AS BEGIN RETURN CASE WHEN x >= <size> THEN 'large' WHEN x IS NULL THEN 'none' ELSE 'small' END; END",
    "MERGE INTO mart.parts t USING staging.parts s ON t.k = s.k WHEN MATCHED THEN UPDATE SET name = s.name WHEN NOT MATCHED THEN INSERT VALUES (s.k, s.name)",
    "DELETE FROM mart.daily_<id> WHERE load_date = CURRENT_DATE;\nINSERT INTO mart.daily_<id> SELECT CAST(o.day AS DATE), SUM(o.v) FROM staging.orders o WHERE o.load_date = CURRENT_DATE GROUP BY 1",
    "INSERT INTO mart.newest SELECT s.k, COALESCE(s.v, 0) FROM staging.orders s WHERE s.updated_at > (SELECT MAX(updated_at) FROM mart.newest)",
    "UPDATE mart.parts SET label = NVL(label, '<type>') WHERE k = <size>",
    "CREATE LOCAL TEMP TABLE tmp_p_<id> ON COMMIT PRESERVE ROWS AS SELECT k, ZEROIFNULL(v) AS v FROM raw.parts",
    "CREATE TEMP TABLE scratch_<id> (k INT, v INT)",
    "CREATE VIEW rpt.month_<id> AS SELECT DATE_TRUNC('month', o.at) AS m, SUM(o.v) AS v, AVG(o.v) AS mean FROM mart.orders o GROUP BY 1 ORDER BY 1",
    'CREATE VIEW rpt.quoted_<id> AS SELECT "Order Id", "<name>" FROM mart."Orders" WHERE flag = 1 AND at AT TIME ZONE \'UTC\' IS NOT NULL',
    "SELECT a.k, b.v, c.w FROM raw.a a JOIN raw.b b ON a.k = b.k LEFT JOIN raw.c c ON b.k = c.k AND c.flag = TRUE WHERE a.kind IN ('<brand>', '<type>')",
    "CREATE VIEW rpt.chain_<id> AS SELECT v.k, v.n FROM rpt.part_<id> v; GRANT SELECT ON rpt.chain_<id> TO readers",
    "CREATE VIEW rpt.self_<id> AS SELECT * FROM rpt.self_<id>",
    "",
)


def case_sql(key: str = "p_partkey") -> str:
    """The SQL expression of a row's text."""
    cases = []
    for i, shape in enumerate(SHAPES):
        parts = re.split(f"<({'|'.join(PLACES)})>", shape.replace("'", "''"))
        terms = [PLACES[p] if k % 2 else f"'{p}'" for k, p in enumerate(parts) if k % 2 or p] or ["''"]
        cases.append(f"WHEN {i} THEN {' || '.join(terms)}")
    return f"CASE CAST({key} % {len(SHAPES)} AS INT) {' '.join(cases)} END"
