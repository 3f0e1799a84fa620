"""Assessment of SQL objects against rows written by hand."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarryflow.operators import assess
from quarryflow.plans import estate
from quarryflow.sources import repository
from quarryflow.sources.tables import run_sql

TEXTS = {
    "repo/v.sql": "CREATE OR REPLACE VIEW rpt.v AS\nWITH base AS (SELECT p.k FROM raw.parts p), n AS (SELECT b.k, COUNT(*) AS c FROM base b GROUP BY b.k)\nSELECT n.k FROM n JOIN raw.stock t ON n.k = t.k JOIN raw.c ON 1 = 1 LEFT JOIN raw.d d ON d.k = n.k",
    "repo/two.sql": "CREATE TABLE w.one (k INT, v FLOAT);\nCREATE TABLE w.two (k INT NOT NULL, w VARCHAR(20) DEFAULT 'a', p DECIMAL(18,2), CONSTRAINT pk PRIMARY KEY (k), UNIQUE (w), CHECK (k > 0));\nINSERT INTO w.two SELECT o.k, 'x', NVL(o.v, 0) FROM w.one o",
    "repo/etl/load.sql": "-- the day's rows\nDELETE FROM m.daily WHERE d = 1; INSERT INTO m.daily SELECT CASE WHEN s.a > 1 THEN 'x' WHEN s.a IS NULL THEN zero ELSE 'y' END FROM st.orders s",
    "repo/proc.sql": "CREATE PROCEDURE etl.p AS BEGIN DECLARE CURSOR c; EXECUTE IMMEDIATE 'SELECT 1'; END",
    "repo/tmp.sql": "CREATE LOCAL TEMP TABLE t1 AS SELECT k FROM raw.x",
    "repo/m.sql": "MERGE INTO m.c USING st.c s ON m.c.k = s.k WHEN MATCHED THEN UPDATE SET v = 1",
    "repo/self.sql": "CREATE VIEW a.self AS SELECT * FROM a.self",
    "repo/models/schema.yml": "models:\n  - name: x",
    "repo/empty.sql": "",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "path string, source_sql string").cache()


def by_path(df):
    return {r["path"]: tuple(r[c] for c in df.columns if c != "path") for r in df.collect()}


def test_types_names_and_loads(texts):
    sql, path = F.col("source_sql"), F.col("path")
    pattern = assess.load_pattern(sql)
    assert by_path(texts.select("path", assess.object_type(path, sql), assess.object_name(path, sql), assess.load_strategy(pattern))) == {
        "repo/v.sql": ("view", "RPT.V", "N/A"),
        "repo/two.sql": ("table", "W.ONE", "N/A"),
        "repo/etl/load.sql": ("sql_script", "LOAD", "delete+insert"),
        "repo/proc.sql": ("stored_procedure", "ETL.P", "N/A"),
        "repo/tmp.sql": ("temp_table", "T1", "N/A"),
        "repo/m.sql": ("sql_script", "M", "merge"),
        "repo/self.sql": ("view", "A.SELF", "N/A"),
        "repo/models/schema.yml": ("dbt_model", "SCHEMA", "N/A"),
        "repo/empty.sql": ("sql_script", "EMPTY", "N/A"),
    }


def test_reads_and_writes(texts):
    found = by_path(texts.select("path", assess.read_tables(F.col("source_sql")), assess.write_targets(F.col("source_sql"))))
    assert found["repo/v.sql"] == (["RAW.C", "RAW.D", "RAW.PARTS", "RAW.STOCK"], ["RPT.V"])
    assert found["repo/two.sql"] == (["W.ONE"], ["W.ONE", "W.TWO"])
    assert found["repo/etl/load.sql"] == (["M.DAILY", "ST.ORDERS"], ["M.DAILY"])
    assert found["repo/tmp.sql"] == (["RAW.X"], ["T1"])
    assert found["repo/m.sql"] == ([], ["M.C"])
    assert found["repo/empty.sql"] == ([], [])
    edges = {tuple(r) for r in assess.lineage_edges(texts).collect()}
    assert {e for e in edges if "A.SELF" in e} == set()  # never a loop
    assert {e for e in edges if "W.ONE" in e} == {("W.ONE", "W.TWO", "writes")}
    assert {e for e in edges if "RPT.V" in e} == {(t, "RPT.V", "reads") for t in ("RAW.C", "RAW.D", "RAW.PARTS", "RAW.STOCK")}


def test_measures_and_risk(texts):
    got = {r["path"]: r for r in assess.assess(texts).collect()}
    names = ("ctes", "joins", "subqueries", "aggregations", "case_expressions", "cursors", "dynamic_sql", "lines", "statements")
    assert tuple(got["repo/v.sql"][n] for n in names) == (1, 3, 2, 1, 0, 0, 0, 3, 1)
    assert tuple(got["repo/proc.sql"][n] for n in names) == (0, 0, 0, 0, 0, 1, 1, 1, 3)
    # a procedure 15, dynamic SQL 20, a cursor 18
    assert (got["repo/proc.sql"]["score"], got["repo/proc.sql"]["level"], got["repo/proc.sql"]["category"], got["repo/proc.sql"]["action"]) == (53, "high", "auto_with_review", "review_and_migrate")
    # a view 3, four tables read 4
    assert (got["repo/v.sql"]["dependencies"], got["repo/v.sql"]["downstream"], got["repo/v.sql"]["score"]) == (4, 0, 7)
    assert (got["repo/tmp.sql"]["score"], got["repo/tmp.sql"]["category"], got["repo/tmp.sql"]["action"]) == (4, "retire", "retire")
    assert got["repo/two.sql"]["features"] == ["NVL (Oracle-style in Vertica)"]


def test_ddl_of_several_tables_without_constraints(texts):
    got = {(r["table"], r["position"], r["column"], r["type"]) for r in assess.ddl_columns(texts).collect()}
    assert got == {("W.ONE", 0, "K", "INT"), ("W.ONE", 1, "V", "FLOAT"), ("W.TWO", 0, "K", "INT"), ("W.TWO", 1, "W", "VARCHAR(20)"), ("W.TWO", 2, "P", "DECIMAL(18,2)")}


def test_columns_and_rules(texts):
    found = by_path(texts.select("path", assess.column_references(F.col("source_sql")), assess.business_rules(F.col("source_sql"))))
    assert found["repo/etl/load.sql"] == (["S.A"], ["s.a > 1 -> 'x'", "s.a IS NULL -> zero"])
    assert found["repo/two.sql"][0] == ["O.K", "O.V", "_UNQUALIFIED.K", "_UNQUALIFIED.W"]
    lineage = {(r["name"], r["source_column"]): r["transforms"] for r in assess.column_lineage(texts).collect()}
    assert lineage["LOAD", "S.A"] == ["case_logic"] and "coalesce" in lineage["W.ONE", "O.V"]


def test_behaviors(texts):
    got = {(r["name"], r["behavior"]) for r in assess.behaviors(texts, "vertica", "snowflake").collect()}
    assert {n for n, b in got if b == "merge_semantics"} == {"M"} and {n for n, b in got if b == "zeroifnull_isnull"} == {"W.ONE"}
    assert "EMPTY" not in {n for n, _ in got} and ("W.ONE", "floating_point_precision") in got


def test_columns_of_one_table(texts):
    """Two objects touch M.C or W.ONE; a table that none touches has no columns."""
    rows = lambda table: {(r["table"], r["source_column"], r["n_objects"]) for r in assess.table_columns(texts, table).collect()}
    assert rows("w.one") == {("W.ONE", c, 1) for c in ("O.K", "O.V", "_UNQUALIFIED.K", "_UNQUALIFIED.W")}
    assert rows("st.Orders") == {("ST.ORDERS", "S.A", 1)} and rows("no.table") == set()
    more = texts.union(texts.sparkSession.createDataFrame([("repo/again.sql", "CREATE VIEW r.again AS SELECT s.a, s.b FROM st.orders s")], texts.schema))
    assert {(r["source_column"], r["n_objects"], r["transforms"]) for r in assess.table_columns(more, "ST.ORDERS").collect()} == {("S.A", 2, "case_logic"), ("S.B", 1, "")}


def test_scope_reduction(texts):
    assert tuple(assess.scope_reduction(assess.assess(texts)).head()) == (9, 1, 11.0)
    assert tuple(assess.scope_reduction(assess.assess(texts.limit(0))).head()) == (0, 0, 0.0)


def test_pairs_are_limited_before_their_category_is_chosen(spark, tmp_path):
    lines = ['{"id": "%d", "category": "%s", "source_sql": "SELECT %d"}' % (i, "date" if i % 2 else "ddl", i) for i in range(6)]
    (tmp_path / "pairs.jsonl").write_text("\n\n".join(lines) + "\n")
    read = lambda **options: [r["id"] for r in repository.read_pairs(spark, str(tmp_path / "pairs.jsonl"), **options).collect()]
    assert read() == list("012345") and read(category="date") == list("135")
    assert read(limit=3) == list("012") and read(limit=3, category="date") == ["1"] and read(limit=0) == []


def test_every_shape_is_made_as_written(spark, folder):
    """Each part has the text of its shape with its own columns in it, quotes and line ends as they were."""
    rows = run_sql(spark, folder, f"SELECT *, {estate.case_sql()} AS source_sql FROM {{part}}").collect()
    for r in rows:
        want = estate.SHAPES[r["p_partkey"] % len(estate.SHAPES)]
        for place, value in (("id", r["p_partkey"]), ("name", r["p_name"]), ("brand", r["p_brand"]), ("type", r["p_type"]), ("size", r["p_size"])):
            want = want.replace(f"<{place}>", str(value))
        assert r["source_sql"] == want
    assert len({r["p_partkey"] % len(estate.SHAPES) for r in rows}) == len(estate.SHAPES) == 40


def test_transforms_equal_their_patterns(spark):
    """The parts found once a text hold what the patterns find, tried for each column by itself."""
    draw = random.Random(5)
    bits = ["SUM(", "sum (", "CASE", " CASE WHEN ", "CAST(", "CAST( CAST (", "NVL(", "TRUNC(", "DATE_TRUNC(", " OVER (", " OVER(", "OVER(", ")", ")", " ", ", ", "A", " a ", "AB", "b", "\n", "CASEA", "x.a"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 25))) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for column in ("a", "AB", "x"):
        got = {r["i"]: r["f"] for r in table.select("i", assess.column_transforms(F.col("t"), column).alias("f")).collect()}
        want = {i: [n for n, p in assess.TRANSFORMS if re.search(p.replace("{c}", column.upper()), t.upper(), re.ASCII)] for i, t in enumerate(texts)}
        assert got == want
    assert {n for found in want.values() for n in found} == {n for n, _ in assess.TRANSFORMS} == set(assess.PARTS)


def test_transforms_of_a_long_text(spark):
    """A text of 20,000 lines without a bracket is gone through once; from every place to its end took minutes."""
    text = "SELECT v.v OVER\n" + "v := v + 1;\n" * 40_000
    table = spark.createDataFrame([("repo/long.sql", text)], "path string, source_sql string")
    began = time.monotonic()
    assert table.select(assess.column_transforms(F.col("source_sql"), "v").alias("t")).head()["t"] == []
    assert [r["transforms"] for r in assess.column_lineage(table).collect()] == [[]]
    assert time.monotonic() - began < 30


def test_objects_of_one_name_count_once(texts):
    again = texts.sparkSession.createDataFrame([("a/same.sql", "SELECT s.k FROM m.one s"), ("b/same.sql", "SELECT s.k, s.v, CAST(s.k AS INT) FROM m.one s JOIN m.two t"), ("c/other.sql", "SELECT s.k FROM m.one s")], texts.schema)
    got = {(r["table"], r["source_column"]): (r["n_objects"], r["transforms"]) for r in assess.table_columns(again).collect()}
    assert got == {("M.ONE", "S.K"): (2, ""), ("M.ONE", "S.V"): (1, ""), ("M.TWO", "S.K"): (1, ""), ("M.TWO", "S.V"): (1, "")}
    assert {(r["source_column"], r["n_objects"]) for r in assess.column_usage(again).collect()} == {("S.K", 2), ("S.V", 1)}
