"""Tables that are rewritten by file, streams into them, hash trees, range joins and sketches."""

import json
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryflow.operators import filetable, hashtree, intervals, reconcile, sketches
from quarryflow.streaming import increments, upserts

SCHEMA = "k long, v string, at int"


def names(path):
    return {n for n in os.listdir(path) if n.endswith(".parquet")}


def content(spark, path):
    return sorted([tuple(r) for r in filetable.read(spark, path, spark.createDataFrame([], SCHEMA).schema).collect()], key=str)


@pytest.fixture
def stored(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(k, f"v{k}", 0) for k in range(100)], SCHEMA).repartitionByRange(5, "k").write.parquet(path)
    spark.createDataFrame([(None, "null", 0)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def test_merge_rewrites_only_touched_files(spark, stored):
    before = names(stored)
    source = spark.createDataFrame([(3, "old", 1), (3, "new", 2), (4, "x", None), (4, "y", 1), (500, "fresh", 1), (None, "other", 1)], SCHEMA)
    gone = filetable.merge_files(spark, stored, source, ["k"], ["at"])
    assert len(gone) == 2 and set(gone) <= before and before - set(gone) <= names(stored) and not set(gone) & names(stored)
    want = [(k, {3: "new", 4: "y"}.get(k, f"v{k}"), {3: 2, 4: 1}.get(k, 0)) for k in range(100)] + [(500, "fresh", 1), (None, "other", 1)]
    assert content(spark, stored) == sorted(want, key=str)
    assert filetable.merge_files(spark, stored, source.limit(0), ["k"], ["at"]) == [] and content(spark, stored) == sorted(want, key=str)


def test_update_and_delete_by_file(spark, stored):
    before = names(stored)
    assert len(filetable.update_files(spark, stored, F.col("k") == 50, {"v": F.lit("u")})) == 1
    assert len(before & names(stored)) == len(before) - 1
    assert len(filetable.delete_files(spark, stored, F.col("k") < 3)) == 1 and filetable.delete_files(spark, stored, F.col("k") < 3) == []
    found = content(spark, stored)
    assert len(found) == 98 and (50, "u", 0) in found and (None, "null", 0) in found


def test_tokens_and_late_rows(spark, tmp_path):
    path = f"{tmp_path}/new"
    one = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], SCHEMA)
    filetable.merge_files(spark, path, one, ["k"], ["at"], token="batch-0", newest=True)
    filetable.merge_files(spark, path, spark.createDataFrame([(1, "late", 3), (2, "next", 6)], SCHEMA), ["k"], ["at"], token="batch-1", newest=True)
    assert content(spark, path) == [(1, "a", 5), (2, "next", 6)]
    filetable.merge_files(spark, path, spark.createDataFrame([(1, "again", 9)], SCHEMA), ["k"], ["at"], token="batch-1", newest=True)
    assert content(spark, path) == [(1, "a", 5), (2, "next", 6)]


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_an_interrupted_change_is_finished(spark, stored, moved):
    """A driver that fails after its intent, with some files moved or deleted, leaves the rest to the next writer."""
    store = filetable._Store(spark, stored)
    gone = sorted(names(stored))[:2]
    old = {tuple(r) for n in gone for r in spark.read.parquet(f"{stored}/{n}").collect()}
    spark.createDataFrame([(k, "n", 9) for k in range(4)], SCHEMA).repartition(2).write.parquet(f"{stored}/_staged-x")
    store.put(filetable.INTENT, json.dumps({"staged": "_staged-x", "gone": gone, "token": "tok"}))
    parts = [n for n in store.names("_staged-x") if n.endswith(".parquet")]
    for n in parts[:moved]:
        store.fs.rename(store.at(f"_staged-x/{n}"), store.at(f"tok-{n}"))
    if moved == 2:
        store.fs.delete(store.at(gone[0]), False)
    want = sorted((set((k, f"v{k}", 0) for k in range(100)) | {(None, "null", 0)}) - old | {(k, "n", 9) for k in range(4)}, key=str)
    spark.createDataFrame([(1, "stray", 1)], SCHEMA).write.parquet(f"{stored}/_staged-y")  # no intent came of it
    filetable.finish(spark, stored)
    assert content(spark, stored) == want and filetable.is_done(spark, stored, "tok")
    assert not [n for n in os.listdir(stored) if n.startswith(("_staged", "_intent"))]
    filetable.finish(spark, stored)
    assert content(spark, stored) == want


def test_stream_upsert_after_restarts(spark, tmp_path):
    draw, rows = random.Random(6), []
    for k in range(4):
        part = [(draw.choice([None, *range(12)]), f"v{k}-{i}", draw.randint(0, 1000) * 10 + i) for i in range(30)]
        rows += part
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = increments.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, files_a_batch=1)
        upserts.upsert(stream, f"{tmp_path}/table", ["k"], ["at", "v"], f"{tmp_path}/checkpoint").awaitTermination()
    best = {}
    for r in rows:
        if r[0] not in best or (r[2], r[1]) > (best[r[0]][2], best[r[0]][1]):
            best[r[0]] = r
    assert content(spark, f"{tmp_path}/table") == sorted(best.values(), key=str)


def test_streams_joined_and_without_duplicates(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(1, "a", start), (1, "a", start), (2, "b", start), (1, "c", start + timedelta(minutes=20)), (2, "c", start + timedelta(hours=3))]
    spark.createDataFrame(rows, "k long, v string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    read = lambda: increments.read_files(spark, f"{tmp_path}/in", schema)

    def run(stream, name):
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}").collect()

    assert sorted((r["k"], r["v"]) for r in run(upserts.once(read(), ["k", "v"], "ts"), "once")) == [(1, "a"), (1, "c"), (2, "b"), (2, "c")]
    both = run(upserts.followed_by(read().where("v <> 'c'"), read().where("v = 'c'"), "k", "ts", "1 HOUR"), "both")
    assert [(r["a"]["k"], r["b"]["v"]) for r in both] == [(1, "c"), (1, "c")]


@pytest.mark.parametrize("depth", [1, 2, None])
def test_hash_tree_finds_what_the_full_diff_finds(spark, depth):
    draw = random.Random(8)
    rows = [(i if i else None, draw.choice([None, "a", "", "~"]), draw.randint(0, 5)) for i in range(2000)]
    other = [(k, v, n + 1) if draw.random() < 0.01 else (k, None if v == "~" else v, n) if draw.random() < 0.01 else (k, v, n) for k, v, n in rows if draw.random() > 0.01] + [(9000 + i, "x", 1) for i in range(5)]
    one, two = (spark.createDataFrame(r, "k long, v string, n int") for r in (rows, other))
    full = reconcile.value_diff(one, two, ["k"], ["v", "n"])
    found = hashtree.tree_diff(one, two, ["k"], ["v", "n"], depth)
    assert sorted(map(str, found.collect())) == sorted(map(str, full.collect())) and full.count() > 20
    assert hashtree.tree_diff(one, one, ["k"], ["v", "n"], depth).count() == 0
    assert hashtree.tree_diff(one.limit(0), two.limit(0), ["k"], ["v", "n"], depth).count() == 0
    assert hashtree.checksum(one, ["k", "v", "n"]).head() == hashtree.checksum(one.orderBy(F.rand(1)), ["k", "v", "n"]).head()
    texts = [r["t"] for r in spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("~", None), ("=", "a")], "x string, y string").select(hashtree.row_text(["x", "y"]).alias("t")).collect()]
    assert len(set(texts)) == 5


@pytest.mark.parametrize("width,parts", [(1, 1), (7, 3), (1000, 1)])
def test_interval_join_equals_all_pairs(spark, width, parts):
    draw = random.Random(11)
    ranges = lambda n: [(i, draw.choice([1, 2, None]), (a := draw.randint(-50, 50)), a + draw.choice([0, 0, 3, 20, -1])) for i in range(n)] + [(-1, 1, None, 5), (-2, 1, 5, None), (-3, 1, 4, 4), (-3, 1, 4, 4)]
    left, right = ranges(60), ranges(50)
    one, two = (spark.createDataFrame(r, "id long, g long, a long, b long") for r in (left, right))
    meets = lambda x, y: None not in (x[2], x[3], y[2], y[3]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    got = intervals.interval_join(one, two, ("a", "b"), ("a", "b"), width, parts=parts).select("l.id", "r.id").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], y[0]) for x in left for y in right if meets(x, y))
    got = intervals.interval_join(one, two, ("a", "b"), ("a", "b"), width, on=["g"], parts=parts).select("l.id", "r.id").collect()
    assert sorted(map(tuple, got)) == sorted((x[0], y[0]) for x in left for y in right if meets(x, y) and x[1] is not None and x[1] == y[1])
    plan = intervals.interval_join(one, two, ("a", "b"), ("a", "b"), width)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_merge(spark):
    rows = spark.range(50_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("kind"), (F.col("id") % 20_000).alias("user"), F.col("id").cast("double").alias("x"))
    rows = rows.union(spark.createDataFrame([(1, 9, None, None)], "day long, kind long, user long, x double"))
    fine = sketches.make(rows, ["day", "kind"], "user", "x")
    got = {r["kind"]: r for r in sketches.estimates(sketches.roll_up(fine, ["kind"]), ["kind"]).collect()}
    exact = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.countDistinct("user").alias("n")).collect()}
    for k in range(3):
        assert abs(got[k]["distinct"] - exact[k]) <= 0.05 * exact[k] and abs(got[k]["q50"] - 25_000) < 1000 and abs(got[k]["q90"] - 45_000) < 1000
    assert got[9]["distinct"] == 0 and got[9]["rows"] == 1 and got[9]["q50"] is None
    assert sketches.estimates(sketches.roll_up(fine.limit(0), ["kind"]), ["kind"]).count() == 0


@pytest.mark.parametrize("width,parts", [(1, 1), (7, 3), (1000, 2)])
def test_points_within_equal_all_pairs(spark, width, parts):
    draw = random.Random(3)
    rows = lambda n: [(draw.choice([None, *range(n)]), draw.choice([None, *range(-40, 40)])) for _ in range(n)]
    left, right = rows(80), rows(60)
    one, two = (spark.createDataFrame(r, "id long, at long") for r in (left, right))
    want = {}
    for i, x in left:
        for j, y in right:
            if x is not None and y is not None and abs(x - y) <= 5:
                want.setdefault(i, []).append((abs(x - y), j))
    want = {i: (len(v), min(d for d, _ in v), min((j for _, j in v if j is not None), default=None)) for i, v in want.items()}
    got = intervals.points_within(one, two, 5, width, parts).collect()
    assert {r["id"]: (r["n"], r["nearest"], r["first"]) for r in got} == want and len(got) == len(want)
    assert intervals.points_within(one, two.limit(0), 5, width).count() == 0


def test_points_within_never_make_pairs(spark):
    """20,000 points each within reach of all others: 400 million pairs."""
    many = spark.range(20_000).select("id", (F.col("id") % 1000).alias("at"))
    began = time.monotonic()
    assert intervals.points_within(many, many, 1000, 1000).agg(F.sum("n"), F.max("nearest"), F.max("first")).head() == (400_000_000, 0, 0)
    assert time.monotonic() - began < 30
