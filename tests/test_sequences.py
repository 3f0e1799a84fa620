"""Pattern matching, time slices, cycles and flattening against plain Python."""

import json
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quarryflow.operators import cycles, patterns, semistructured, timeseries

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "user long, ts timestamp, id long, sym string, start string, k int, _p int"


def events(spark, rows):
    return spark.createDataFrame([(u, None if t is None else START + timedelta(seconds=t), i, s, "x", 1, 2) for u, t, i, s in rows], EVENTS)


def plain_matches(rows, pattern, within, overlapping):
    out, users = [], {u for u, *_ in rows}
    for user in users:
        mine = sorted(((t, i, s or "_") for u, t, i, s in rows if u == user and t is not None))
        at = 0
        while at < len(mine):
            near = "".join(s for t, _, s in mine[at:] if t <= mine[at][0] + within)
            m = re.match(pattern, near)
            if m and m.group():
                out.append((user, mine[at][1], mine[at + m.end() - 1][1], m.group()))
            at += m.end() if m and m.group() and not overlapping else 1
    return sorted(out, key=str)


@pytest.mark.parametrize("overlapping", [False, True])
@pytest.mark.parametrize("pattern", ["ab+c", "a.{0,5}c", "a.*c", "[ab]{3}|c"])
def test_matches_equal_plain_search(spark, pattern, overlapping):
    draw = random.Random(3)
    rows = [(1, draw.randint(0, 300), i, draw.choice("aabbc")) for i in range(500)]  # a hot user with many ties
    rows += [(draw.choice([2, 3, None]), draw.uniform(0, 3000), 1000 + i, draw.choice(["a", "b", "c", None])) for i in range(150)]
    rows += [(2, None, 5000, "a"), (4, 7, 5001, "a"), (4, -1e9, 5002, "a"), (4, -1e9 + 1, 5003, "c")]
    got = patterns.match_rows(events(spark, rows), ["user"], "ts", ["id"], F.col("sym"), pattern, 20, ["id"], overlapping).collect()
    want = plain_matches(rows, pattern, 20, overlapping)
    assert sorted([(r["user"], r["matched"][0]["id"], r["matched"][-1]["id"], r["symbols"]) for r in got], key=str) == want
    assert all(len(r["matched"]) == len(r["symbols"]) and r["start_us"] <= r["end_us"] for r in got)


def test_long_chains_of_overlapping_matches(spark):
    """Every row begins a match that the next one overlaps: one chain without a row that is free for sure."""
    rows = [(1, i, i, "a") for i in range(400)]
    got = patterns.match_rows(events(spark, rows), ["user"], "ts", ["id"], F.col("sym"), "a{3}", 10, ["id"]).collect()
    assert sorted(r["matched"][0]["id"] for r in got) == list(range(0, 398, 3))
    assert patterns.match_rows(events(spark, []), ["user"], "ts", ["id"], F.col("sym"), "a", 10, ["id"]).count() == 0


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "RUN", 3)
    rows = [(1, 5.0, 1, 10.0), (1, 5.0, 2, 20.0), (1, 95.0, 3, 30.0), (1, 47.5, 4, None), (2, 3.0, 5, 1.0), (None, 0.0, 6, 4.0), (None, 20.0, 7, 8.0), (3, None, 8, 1.0), (4, 1.0, 9, None), (5, -15.0, 10, 2.0), (5, 15.0, 11, 4.0)]
    table = spark.createDataFrame([(u, None if t is None else START + timedelta(seconds=t), i, v, 1) for u, t, i, v in rows], "user long, ts timestamp, id long, value double, k int")
    got = {(r["user"], (r["slice_us"] - int(START.timestamp()) * 10**6) // 10**6): r for r in timeseries.slices(table, ["user"], "ts", ["id"], "value", 10).collect()}
    assert sorted(k for u, k in got if u == 1) == list(range(0, 100, 10)) and sorted(k for u, k in got if u == 5) == [-20, -10, 0, 10]
    assert {u for u, _ in got} == {1, 2, None, 5}
    one = got[1, 0]
    assert (one["n"], one["first_const"], one["last_const"]) == (2, 10.0, 20.0)
    assert [(got[1, k]["n"], got[1, k]["first_const"]) for k in (10, 80)] == [(0, 20.0), (0, 20.0)]
    assert got[1, 50]["first_linear"] == 20 + 10 * 45 / 90 and abs(got[1, 50]["last_linear"] - (20 + 10 * 55 / 90)) < 1e-12
    assert got[1, 90]["last_linear"] == 30 and got[None, 10]["first_linear"] == 6.0 and got[5, -10]["first_linear"] == 2 + 2 * 5 / 30
    assert timeseries.slices(table.limit(0), ["user"], "ts", ["id"], "value", 10).count() == 0


def plain_cycles(edges, longest):
    out, found = {}, set()
    for a, b in edges:
        if a is not None and b is not None:
            out.setdefault(a, set()).add(b)

    def walk(path):
        for n in out.get(path[-1], ()):
            if n == path[0]:
                found.add(tuple(path))
            elif n > path[0] and n not in path and len(path) < longest:
                walk([*path, n])

    for a in out:
        walk([a])
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_equal_plain_search(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 25), draw.randint(0, 25)) for _ in range(45)] + [(7, 7), (7, 7), (None, 3), (3, None), (100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103), (200, 201)]
    table = spark.createDataFrame([(*e, "n") for e in edges], "src long, dst long, node string")
    got = [(tuple(r["cycle"]), r["length"]) for r in cycles.elementary_cycles(table, 5).collect()]
    assert len(got) == len(set(got)) and {c for c, _ in got} == plain_cycles(edges, 5) and all(len(c) == n for c, n in got)
    parts = {}
    for r in cycles.strong_parts(table).collect():
        parts.setdefault(r["part"], set()).add(r["node"])
    assert {100, 101, 102} in parts.values() and {103, 104} in parts.values() and all(p in nodes for p, nodes in parts.items())


def test_cycles_of_few_walks_need_no_parts(spark, monkeypatch):
    """With two ways out of each node, as graph_elementary_cycles has them, walks are followed without looking for parts."""
    monkeypatch.setattr(cycles, "strong_parts", lambda edges: pytest.fail("parts were looked for"))
    draw = random.Random(4)
    edges = {(a, b) for a in range(40) for b in draw.sample(range(40), 2)} | {(50, 51), (51, 50), (60, 60), (61, 60)}
    got = [(tuple(r["cycle"]), r["length"]) for r in cycles.elementary_cycles(spark.createDataFrame(sorted(edges), "src long, dst long"), 6).collect()]
    assert len(got) == len(set(got)) and {c for c, _ in got} == plain_cycles(edges, 6) and all(len(c) == n for c, n in got)


def test_no_cycles(spark):
    table = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    assert cycles.elementary_cycles(table, 20).count() == 0
    assert cycles.elementary_cycles(table.limit(0), 3).count() == 0
    ring = table.union(spark.createDataFrame([(12, 0)], "src long, dst long"))
    assert [r["cycle"] for r in cycles.elementary_cycles(ring, 13).collect()] == [list(range(13))] and cycles.elementary_cycles(ring, 12).count() == 0


def plain_members(value, path="$"):
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        here = path + (f"[{k}]" if isinstance(k, int) else f".{k}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) else '."' + k.replace('"', '\\"') + '"')
        yield here, k if isinstance(k, str) else None, k if isinstance(k, int) else None, v
        yield from plain_members(v, here)


def test_flatten(spark):
    docs = ['{"a": {"b": [1, 2.5, "x", null, true, [[]], {}], "c d": "q"}, "_e1": -7}', "[1, [2, [3, {\"k\\\"q\": \"deep\"}]]]", "3", "null", "not json", "", None, "{}", '{"a": 1}', '{"a": 1}']
    table = spark.createDataFrame([(i, d, "p", 5) for i, d in enumerate(docs)], "id long, doc string, path string, value int")
    got = sorted((r["id"], r["path"], r["key"] or "", -1 if r["index"] is None else r["index"], r["text"]) for r in semistructured.flatten(table, "doc", ["id"]).collect())
    text = lambda v: None if v is None or isinstance(v, (dict, list)) else str(v).lower() if isinstance(v, bool) else str(v)
    want = []
    for i, d in enumerate(docs):
        try:
            found = list(plain_members(json.loads(d or "")))
        except ValueError:
            found = []
        want += [(i, p, k or "", -1 if n is None else n, text(v)) for p, k, n, v in found]
    assert got == sorted(want)
    top = semistructured.flatten(table, "doc", ["id"], recursive=False, outer=True).collect()
    assert sorted(r["id"] for r in top if r["path"] is None) == [2, 3, 4, 5, 6, 7] and sum(r["id"] == 0 for r in top) == 2
    kinds = {r["path"]: r["kind"] for r in semistructured.flatten(table.where("id = 0"), "doc", ["id"], depth=2).collect()}
    assert kinds == {"$.a": "OBJECT", "$._e1": "BIGINT", "$.a.b": "ARRAY", '$.a."c d"': "STRING"}
    variants = table.where("id < 2").select("id", F.parse_json("doc").alias("doc"))
    assert semistructured.flatten(variants, "doc", ["id"]).count() == sum(1 for g in got if g[0] < 2)
    assert semistructured.flatten(table.limit(0), "doc", ["id"]).count() == 0


def test_member_shapes_equal_flattened(spark):
    """Counted as they are read or as variants, the members are those that flatten() gives."""
    docs = ['{"a": {"b": [1, 22, "x", null, true, [[]], {}], "c d": "q"}, "e": -7}', '{"a": {"b": [1, "x"]}}', '[1, [2, [3, {"k\\"q": "deep"}]]]', "[1.50, 1e3, 12345678901234567890, -0]"]
    docs += ['{"a": 1} rest', '{"a": 1, "a": 2}', '{"n[3]": [5], "ü": "ß"}', "{'a': 1}", "[NaN]", "3", "null", "", None, "{}", "[01]", '{"a":\n1}', '{"": {"_x1": [false, [9]]}}', "[" * 12 + "1" + "]" * 12]
    table = spark.createDataFrame([(i % 11, d) for i, d in enumerate(docs * 2)] + [(None, None), (5, docs[0])], "id long, doc string")
    got = semistructured.member_shapes(table, "doc", "id").collect()
    found = semistructured.flatten(table, "doc", ["id"]).withColumn("shape", F.regexp_replace("path", r"\[\d+\]", "[*]"))
    want = found.groupBy("shape", "kind").agg(F.count("*"), F.countDistinct("id"), F.countDistinct("text"), F.max("index").cast("long"), F.min("text"), F.sum(F.length("text"))).collect()
    assert len(got) > 20 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    assert semistructured.member_shapes(table.limit(0), "doc", "id").count() == 0


def test_map_members(spark):
    table = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, None), (3, "[]"), (4, "{}")], "id long, props string")
    got = semistructured.map_members(table, "props", ["id"], "bigint").collect()
    assert sorted((r["id"], r["key"], r["value"]) for r in got) == [(1, "a", 1), (1, "b", None)]
