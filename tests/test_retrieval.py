"""Batched retrieval, the registry's table function and neighbour rows against plain Python."""

import math
import random
import re

import numpy as np
import pytest

from quarryflow.functions import registry
from quarryflow.operators import graph, retrieval


def words(text):
    return {t for t in re.findall("[a-z0-9_]+", (text or "").lower()) if len(t) > 2}


@pytest.mark.parametrize("part", [retrieval.PART, 3])
def test_batched_keywords_equal_plain_scores(spark, part, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", part)
    draw = random.Random(9)
    vocabulary = ["the"] * 6 + [f"w{i}x" for i in range(30)] + ["a", "of"]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(0, 12)))) for i in range(80)] + [(90, None), (91, "The THE the"), (92, "the"), (93, "the")]
    requests = [(i, " ".join(draw.choices(vocabulary, k=4))) for i in range(12)] + [(20, "the"), (21, None), (22, "zzz none"), (23, "a of")]
    index = retrieval.postings(spark.createDataFrame([(*d, 1) for d in docs], "id long, text string, n int"), "id", "text")
    got = retrieval.keyword_topk_many(index, spark.createDataFrame(requests, "rid long, ask string"), "rid", "ask", 5).collect()
    want = []
    for r, ask in requests:
        q = words(ask)
        scored = sorted((-round(len(q & words(t)) / math.sqrt(len(q) * len(words(t))), 6), i) for i, t in docs if q & words(t))
        want += [(r, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert sorted((r["request"], r["rank"], r["key"], r["score"]) for r in got) == sorted(want)
    assert retrieval.keyword_topk_many(index.limit(0), spark.createDataFrame(requests, "rid long, ask string"), "rid", "ask").count() == 0


@pytest.mark.parametrize("asks,rows", [(1024, 8192), (2, 7)])
def test_routed_vectors_equal_plain_scores(spark, asks, rows, monkeypatch):
    monkeypatch.setattr(retrieval, "ASKS", asks)
    monkeypatch.setattr(retrieval, "ROWS", rows)
    rng = np.random.default_rng(10)
    held = [(i, rng.normal(size=4).tolist(), [0, 0, 0, 1, None][i % 5]) for i in range(60)] + [(100, [1.0, 0.0, 0.0, 0.0], 3), (101, [2.0, 0.0, 0.0, 0.0], 3), (102, None, 7), (103, [0.0] * 4, 7), (104, [1.0, None, 0.0, 0.0], 7), (105, [float("nan")] * 4, 7), (106, [1.0, 2.0], 0)]
    asked = [(i, [0, 1, 3, 7, None, 9][i % 6], rng.normal(size=4).tolist()) for i in range(12)] + [(50, 0, None), (51, 0, [1.0, 1.0])]
    table = spark.createDataFrame([(*h, "x", 1) for h in held], "id long, vec array<double>, label long, route string, block int")
    got = retrieval.routed_topk(spark.createDataFrame(asked, "request long, route long, v array<double>"), table.drop("route"), "id", "vec", "label", 3).collect()
    usable = [h for h in held if h[1] and all(x is not None and math.isfinite(x) for x in h[1]) and any(h[1])]
    want = []
    for r, route, v in asked:
        near = [h for h in usable if v and len(h[1]) == len(v)]
        routed = route is not None and any(h[2] == route for h in near)
        near = [h for h in near if not routed or h[2] == route]
        cosine = lambda x: round(sum(a * b for a, b in zip(x, v, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in v)), 6)
        want += [(r, n + 1, i, -s, routed) for n, (s, i) in enumerate(sorted((-cosine(h[1]), h[0]) for h in near)[:3])]
    assert sorted((r["request"], r["rank"], r["key"], r["score"], r["routed"]) for r in got) == sorted(want)


def test_sentences(spark):
    registry.register(spark)
    texts = [("en", "One two. Three!  Four five six? tail"), ("en", None), (None, "  \n"), ("de", "A.b. C"), (None, "x")]
    got = spark.sql("SELECT * FROM sentences_of(TABLE({t}))", t=spark.createDataFrame(texts, "lang string, text string")).collect()
    assert sorted((r["lang"] or "", r["place"], r["sentence"], r["words"]) for r in got) == [("", 0, "x", 1), ("de", 0, "A.b.", 1), ("de", 1, "C", 1), ("en", 0, "One two.", 2), ("en", 1, "Three!", 1), ("en", 2, "Four five six?", 3), ("en", 3, "tail", 1)]


def test_neighbour_rows(spark):
    edges = spark.createDataFrame([("hub", f"n{i}") for i in range(50)] + [("hub", "n1"), ("n1", "hub"), (None, "n1")], "src string, dst string")
    got = {(r["node"], r["direction"], r["neighbour"]) for r in graph.neighbour_rows(edges).collect()}
    assert sum(n == "hub" and d == "downstream" for n, d, _ in got) == 50 and ("n1", "upstream", None) in got and ("hub", "upstream", "n1") in got
