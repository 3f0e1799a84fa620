import numpy as np
from pyspark.sql import functions as F

from quarryflow.llm import neighbours, queries


def exact(ids, vectors, query, k=10):
    own = ids.index(query)
    d = np.sqrt(((vectors - vectors[own]) ** 2).sum(1))
    order = sorted((d[i], ids[i]) for i in range(len(ids)) if i != own)[:k]
    return [i for _, i in order], [s for s, _ in order]


def test_recall_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got, hits = queries.op9_adaptive_scan_ann(spark, folder).collect(), 0
    asked = [i for i in ids if i % 100 == 0]
    for q in asked:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and q not in [m[1] for m in mine]
        hits += len({m[1] for m in mine} & set(exact(ids, vectors, q)[0]))
        for _, i, s in mine:
            assert abs(s - np.sqrt(((vectors[ids.index(i)] - vectors[ids.index(q)]) ** 2).sum())) < 1e-12
    assert hits >= 0.9 * 10 * len(asked)


def test_adaptive_scan_keeps_the_nearest():
    rng = np.random.default_rng(2)
    x, turn = rng.standard_normal((5000, 64)), neighbours.rotation(64)
    hits = 0
    for q in x[:50]:
        near = neighbours.scan(q @ turn, x @ turn, 11)
        hits += len(set(np.argsort(((x - q) ** 2).sum(1))[:11]) & set(near))
        assert len(near) < 2500
    assert hits >= 0.97 * 50 * 11


def test_odd_vectors(spark):
    good = [(i, [1.0 + i, 2.0, 0.5]) for i in range(1, 8)]
    odd = [(100, [2.0, 2.0, 0.5]), (100, [2.0, 2.0, 0.5]), (8, None), (9, [0.0, 0.0, 0.0]), (10, [1.0, None, 2.0]), (11, [float("nan"), 1.0, 1.0]), (12, [float("inf"), 1.0, 1.0]), (13, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(table, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False))).collect()
    assert len(got) == 2 * 8 and {r["vec_id"] for r in got} == {*range(1, 8), 100}
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])[:4]] == [(1, 0.0), (1, 0.0), (100, 0.0), (100, 0.0)]
    assert neighbours.nearest_neighbours(table.limit(0), F.lit(True)).count() == 0


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(4)
    vectors = [[1.0, 1.0, 0.0]] * 200 + rng.random((100, 3)).tolist()
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0).collect()
    for q in range(0, 300, 50):
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == exact(list(range(300)), np.array(vectors), q)[0]


def recall(spark, vectors, asks):
    """The share of the 10 nearest found, by exact search; asks: every so many vectors is a query."""
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(table, F.col("vec_id") % asks == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(vectors), asks):
        far = ((vectors - vectors[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(got[q] & set(np.argpartition(far, 10)[:10].tolist()))
    return hits / (10 * len(got))


def test_recall_with_and_without_clusters(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((150, 64)) * 3
    assert recall(spark, rng.standard_normal((12_000, 64)), 100) >= 0.9
    monkeypatch.setattr(neighbours, "ASKS", 3)  # several groups of queries a list
    monkeypatch.setattr(neighbours, "PART", 64)
    assert recall(spark, centres[rng.integers(150, size=12_000)] + rng.standard_normal((12_000, 64)), 100) >= 0.95


def test_lists_that_a_bounded_query_leaves_out():
    """With clusters the scan drops nearly all rows in the first block of columns once a bound is known."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 64)) + 3 * rng.standard_normal((40, 64))[rng.integers(40, size=4000)]
    turned = x @ neighbours.rotation(64)
    for q in range(20):
        far = ((x - x[q]) ** 2).sum(1)
        bound = np.sort(far)[10]
        rows = neighbours.scan_all(turned[q : q + 1], turned, np.array([bound]), 11)[1]
        assert len(rows) <= 12 and len(set(rows) & set(np.argsort(far)[:11])) >= 10
