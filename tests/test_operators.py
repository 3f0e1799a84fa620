import io
import zipfile

from pyspark.sql import functions as F

from quarryflow.functions import dialect
from quarryflow.operators import assess, graph, incremental, reconcile, retrieval, risk_model, text_metrics
from quarryflow.sources import repository
from quarryflow.streaming import increments


def test_scan_folder_and_zip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.sql").write_text("SELECT 1;\nSELECT 2")
    (tmp_path / "a" / "blank.sql").write_text("  ")
    (tmp_path / "a" / "notes.txt").write_text("no")
    found = repository.scan(spark, f"file://{tmp_path}/a").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["lines"]) for r in found] == [("one.sql", 2)]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x/two.sql", "SELECT 2")
        z.writestr("venv/three.sql", "SELECT 3")
    (tmp_path / "r.zip").write_bytes(raw.getvalue())
    assert [r["source_sql"] for r in repository.scan(spark, f"file://{tmp_path}/r.zip").collect()] == ["SELECT 2"]


def test_sample_table_and_leaderboard(spark):
    df = repository.sample_table(spark, {"d": "date", "k": "id", "a": "amount", "n": "name", "x": "other"})
    assert df.count() == 5 and df.where("a IS NULL").count() == 1
    board = spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.9, 0.1)], "name string, pass_rate double, token_f1 double")
    top = repository.append_leaderboard(board, board.limit(1).withColumn("name", F.lit("c")).withColumn("pass_rate", F.lit(0.7)), 2)
    assert [r["name"] for r in top.collect()] == ["b", "c"]


def test_dialect_functions(spark):
    dialect.register(spark)
    assert spark.sql("SELECT getdate() IS NOT NULL AS x").head()["x"]
    row = spark.range(1).select(
        dialect.iff(F.col("id") == 0, F.lit("a"), F.lit("b")).alias("i"),
        dialect.isnull2(F.lit(None).cast("int"), F.lit(3)).alias("n"),
        dialect.safe_cast(F.lit("x"), "int").alias("c"),
        dialect.day_diff(F.lit("2024-01-01"), F.lit("2024-03-01")).alias("d"),
        dialect.minus_days(F.lit("2024-01-04").cast("date"), 3, True).cast("string").alias("m"),
        dialect.to_char(F.lit(5)).alias("t"),
    ).head()
    assert tuple(row) == ("a", 3, None, 60, "2024-01-01", "5")


def test_incremental_cases(spark):
    empty = spark.createDataFrame([], "k int, v int")
    one = spark.createDataFrame([(1, 5), (1, 7), (None, 3)], "k int, v int")
    assert sorted(r["v"] for r in incremental.merge_upsert(empty, one, ["k"], ["v"]).collect()) == [3, 7]
    assert incremental.watermark_append(empty, one, "v").count() == 3
    assert incremental.delete_insert(one, one.where("k = 1"), ["k"]).count() == 3


def test_graph_cases(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], "src string, dst string")
    assert {(r["node"], r["length"]) for r in graph.on_cycles(edges, 5).collect()} == {("a", 3), ("b", 3), ("c", 3), ("d", 1)}
    reach = graph.reachability(edges, spark.createDataFrame([("a",)], "node string"), 5)
    assert {(r["node"], r["distance"]) for r in reach.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_text_metrics(spark):
    pairs = spark.createDataFrame([(1, "SELECT a -- x\nFROM t;", "select a from t"), (2, "", ""), (3, "a", "")], "k int, p string, g string")
    got = {r["k"]: (r["exact_match"], round(r["token_f1"], 6), r["fuzzy"], r["passed"]) for r in text_metrics.evaluate(pairs, "k", "p", "g").collect()}
    assert got == {1: (1.0, 1.0, 1.0, True), 2: (1.0, 1.0, 1.0, True), 3: (0.0, 0.0, 0.0, False)}


def test_checksum_ignores_order(spark):
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    a, b = (reconcile.checksum(x, ["id", "v"]).head() for x in (df, df.orderBy(F.desc("id"))))
    assert a == b and a["row_count"] == 50


def test_streams(spark, folder, tmp_path):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = tmp_path / "in"
    spark.read.parquet(f"{folder}/events.parquet").write.parquet(str(source))
    for _ in range(2):  # the second run finds nothing new
        increments.append_new(increments.read_files(spark, str(source), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(source)).count()
    query = increments.daily_counts(increments.read_files(spark, str(source), schema)).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT SUM(n) AS n FROM days").head()["n"] == spark.read.parquet(str(source)).count()


def test_scan_replaces_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "latin.sql").write_bytes(b"SELECT '\xe9' AS x")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "built.sql").write_text("SELECT 1")
    found = repository.scan(spark, f"file://{tmp_path}").collect()
    assert [r["source_sql"] for r in found] == ["SELECT '�' AS x"]


def test_null_is_a_key_like_others(spark):
    target = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    fresh = spark.createDataFrame([(None, 9)], "k int, v int")
    want = [(None, 9), (2, 2)]
    for got in (incremental.delete_insert(target, fresh, ["k"]), incremental.merge_upsert(target, fresh, ["k"], ["v"])):
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert reconcile.sample_diff(target, target, ["k"]).count() == 0
    got = reconcile.value_diff(target, fresh, ["k"], ["v"]).collect()
    assert {(r["k"], r["n_source"], r["n_target"], r["changed"]) for r in got} == {(None, 1, 1, "v"), (2, 1, 0, "")}


def test_reachability_both_ways(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "src string, dst string")
    start = spark.createDataFrame([("b",)], "node string")
    reach = lambda way: {(r["node"], r["distance"]) for r in graph.reachability(edges, start, 5, way).collect()}
    assert reach("upstream") == {("b", 0), ("a", 1)} and reach("both") == {("b", 0), ("a", 1), ("c", 1), ("x", 2)}


def test_full_refresh(spark, tmp_path):
    for n in (3, 2):
        incremental.full_refresh(spark.range(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_risk_model_on_other_rows(spark):
    texts = [(f"SELECT a{i} FROM t", "low") for i in range(12)] + [(f"MERGE INTO m{i} USING s ON a = b", "medium") for i in range(12)] + [("EXECUTE IMMEDIATE 'x'", "high")] * 3
    labelled = spark.createDataFrame(texts, "source_sql string, level string")
    other = spark.createDataFrame([("SELECT zz FROM t",), ("MERGE INTO zz USING s ON a = b",), ("DECLARE CURSOR c",)], "source_sql string")
    got = {r["source_sql"]: r for r in risk_model.predict(risk_model.fit(labelled), other).collect()}
    assert [got[t]["predicted"] for t in ("SELECT zz FROM t", "MERGE INTO zz USING s ON a = b", "DECLARE CURSOR c")] == ["low", "medium", "high"]
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-6 for r in got.values()) and got["DECLARE CURSOR c"]["probabilities"]["high"] == 0.8


def test_features_of_every_dialect(spark):
    texts = {"oracle": ("SELECT ROWNUM FROM DUAL", "ROWNUM,DUAL table"), "redshift": ("CREATE TABLE t (a int) DISTSTYLE ALL", "DISTSTYLE"), "bigquery": ("SELECT 1 QUALIFY ROW_NUMBER() OVER () = 1", "QUALIFY"), "snowflake": ("SELECT * FROM LATERAL FLATTEN(x)", "FLATTEN")}
    for name, (text, want) in texts.items():
        assert spark.range(1).select(F.array_join(assess.features(F.lit(text), name), ",").alias("f")).head()["f"] == want


def test_intent_rules(spark):
    asked = ["Convert to pandas", "migrate it and explain", "how risky is it", "null or timezone", "why", "translate", "hello"]
    df = spark.createDataFrame([(a,) for a in asked], "p string")
    assert [r["i"] for r in df.select(retrieval.intent(F.col("p"), F.lit("")).alias("i")).collect()] == ["full", "full", "explain", "rag", "explain", "full", "rag"]
    assert df.select(retrieval.intent(F.lit("null"), F.lit("SELECT 1")).alias("i")).head()["i"] == "full"


def test_update_and_formats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert sorted(r["v"] for r in incremental.update(df, F.col("k") > 1, {"v": F.lit("z")}).collect()) == ["a", "c", "z"]
    moment = F.lit("2024-03-05 14:07:09").cast("timestamp")
    assert spark.range(1).select(dialect.to_char_format(moment, "DD-MON-YYYY HH24:MI:SS").alias("t")).head()["t"] == "05-Mar-2024 14:07:09"
    diff = lambda unit, a, b: spark.range(1).select(dialect.date_diff(unit, F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")).alias("n")).head()["n"]
    assert [diff(u, "2023-12-31 23:59:59", "2024-01-01 00:00:00") for u in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")] == [1] * 8


def test_risk_vocabulary(spark):
    """Occurrences decide which n-grams are known, then their letters; the number of texts goes with each."""
    texts = ["abcabcabc", "abcé😀é", "ab", "", "xé😀é", "xyzxyz"]
    got = risk_model.vocabulary(spark.createDataFrame([(t,) for t in texts], "plain string").repartition(2))
    for n in risk_model.LENGTHS:
        found = [{t[i : i + n] for i in range(len(t) - n + 1)} for t in texts]
        times = lambda g: sum(t[i : i + n] == g for t in texts for i in range(len(t) - n + 1))  # noqa: B023, E731
        held = {g: sum(g in f for f in found) for f in found for g in f}
        assert got[n] == [(g, held[g]) for g in sorted(held, key=lambda g: (-times(g), g)) if held[g] >= 2]
    assert got[3] == [("abc", 2), ("é😀é", 2)]


def test_parts_of_risk_texts(spark, tmp_path, monkeypatch):
    """Texts and vectors make few bytes as files, so parts are made by characters, read as they are, and few rows at once."""
    assert [risk_model.parts(n, 8) for n in (0, 1, 4_000_000, 80_000_001)] == [1, 1, 8, 11]
    spark.range(90).repartition(9).write.parquet(str(tmp_path / "t"))
    seen, read = [], risk_model.file_by_file

    def watched(*args):
        seen.append(read(*args))
        return seen[-1]

    monkeypatch.setattr(risk_model, "file_by_file", watched)
    monkeypatch.setattr(risk_model, "LARGEST", 100)
    whole = watched(spark, str(tmp_path / "t"), spark.range(1).schema, 16)
    assert whole.rdd.getNumPartitions() == 9 and whole.count() == 90
    texts = [(f"SELECT a{i} FROM t{i}", "low") for i in range(40)] + [(f"MERGE INTO m{i} USING s", "medium") for i in range(40)]
    model = risk_model.fit(spark.createDataFrame(texts, "source_sql string, level string"))
    assert model.labels == ["low", "medium"]
    for df in seen[1:]:
        assert df.rdd.getNumPartitions() == risk_model.parts(sum(len(t) for t, _ in texts), 4) > 10
        assert int(df.sparkSession.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == risk_model.TEXTS
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == 4096
