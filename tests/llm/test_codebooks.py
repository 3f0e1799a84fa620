"""Operator 12 against plain Lloyd rounds over Python integers."""

import math
import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryflow.llm import codebooks, queries


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0]))
    width = len(kept[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]
    distance = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda k: (distance(x, book[k]), k))
    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for x in parts[p]:
                members[near(x, books[p])].append(x)
            for k, found in members.items():
                books[p][k] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    total, out = defaultdict(int), []
    for n, (i, _, label) in enumerate(kept):
        codes = [near(parts[p][n], books[p]) for p in range(4)]
        error = sum(distance(parts[p][n], books[p][codes[p]]) for p in range(4))
        total[label] += error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, label))
    digest = sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted([(i, code, error, total[label], digest) for i, code, error, label in out], key=str)


def answers(df):
    return sorted([tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()], key=str)


@pytest.mark.parametrize("hot", [codebooks.HOT_LABELS, 3])
def test_query_equals_brute_force(spark, folder, hot, monkeypatch):
    monkeypatch.setattr(codebooks, "HOT_LABELS", hot)
    monkeypatch.setattr(codebooks, "BLOCK", 50)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert answers(queries.op12_vector_codes(spark, folder)) == brute(rows)


def test_odd_vectors(spark, tmp_path):
    draw = random.Random(12)
    good = [(i if i != 5 else None, [draw.uniform(-2, 2) for _ in range(8)], draw.choice([None, 1, 2])) for i in range(300)]
    good += [(1000 + i, [0.5] * 8, 3) for i in range(150)] + [(7, good[7][1], 1)]
    odd = [(400, None, 1), (401, [], 1), (402, [1.0, None] * 4, 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] * 8, 2), (405, [1.0] * 4, 1), (406, [1.0] * 9, None), (407, [1e30] * 8, 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in good + odd], "vec_id long, embedding array<double>, label int, row string, codes int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert answers(queries.op12_vector_codes(spark, str(tmp_path))) == brute(good)
    rows, books = codebooks.compress(table.limit(0))
    assert rows.count() == 0 and books.size == 0 and rows.columns == ["vec_id", "label", "codes", "error", "label_error"]
    few, books = codebooks.compress(table.where("vec_id < 3 OR vec_id = 400"))
    assert [r["error"] for r in few.collect()] == [0, 0, 0] and books.shape == (4, 3, 2)


def test_rounds_shuffle_only_what_moved(spark):
    """Clusters settle: later rounds see fewer changed parts, and no round moves a vector."""
    rng = np.random.default_rng(12)
    centres = rng.uniform(-4, 4, (20, 8))
    table = spark.createDataFrame([(i, (centres[i % 20] + rng.normal(0, 0.05, 8)).tolist(), 0) for i in range(2000)], "vec_id long, embedding array<double>, label int")
    whole = codebooks.whole_numbers(table, "embedding", 1024, 4).withColumn("row", F.monotonically_increasing_id())
    vectors = codebooks.Bucketed(whole, 3, "vectors")
    first = np.array([r["v"] for r in whole.orderBy("vec_id").limit(40).collect()], np.int64).reshape(40, 4, 2).transpose(1, 0, 2)
    _, moves = codebooks.trained(vectors, first, 5)
    assert moves[0] == 8000 and moves[-1] < moves[1] < 4000
    codes = codebooks.Bucketed(codebooks.one_round(vectors.df.select("row", "v"), first), 3, "codes", dealt=True)
    plan = codebooks._beside(vectors, codes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    for one in (vectors, codes):
        one.discard()


def test_large_whole_numbers_are_exact():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-(2**28), 2**28, (40, 2)), rng.integers(-(2**28), 2**28, (9, 2))
    codes, errors = codebooks.nearest(x, book)
    for row, c, e in zip(x.tolist(), codes.tolist(), errors.tolist(), strict=True):
        d = [sum((a - b) ** 2 for a, b in zip(row, entry, strict=True)) for entry in book.tolist()]
        assert d.index(min(d)) == c and min(d) == e
