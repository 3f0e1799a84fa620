"""Operator 13: exact round trip of archives, deterministic files, damage and repeated attempts."""

import gzip
import os
from base64 import b32encode
from hashlib import sha1

import pytest

from quarryflow.llm import archives, queries

SCHEMA = "page_id long, url string, html string, row string, payload int, shard string, target string"


def brute(rows, min_bytes=0):
    payload = [(h or "").encode() for _, _, h in rows]
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or "", i)
    last = {}
    for i, p in enumerate(payload):
        if p not in last or order(i) > order(last[p]):
            last[p] = i
    out = []
    for i, p in enumerate(payload):
        whole = len(p) < min_bytes or last[p] == i
        out.append((rows[i][0], len(p), b32encode(sha1(p).digest()).decode(), "response" if whole else "revisit", None if whole else rows[last[p]][0]))
    return sorted(out, key=str)


def answers(df):
    return sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in df.collect()], key=str)


ROWS = [(i, f"http://h{i % 7}.org/p?q={i}", f"<p>page {i % 40} ünï 😀</p>" * (1 + i % 5)) for i in range(300)]
ROWS += [(1000 + i, None if i % 2 else "http://x.org/ä b\r\nX-Page-ID: 7", "hot page") for i in range(150)]
ROWS += [(2000, "u", None), (2001, "u", ""), (2002, None, None), (None, "n", "hot page"), (None, None, "alone"), (2003, "u", "long " * 400_000), (2**62 + 1, "u", "big id"), (2**62, "u", "big id"), (5, "again", "hot page"), (5, "again", "hot page"), (2004, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n\r\n"), (-7, "u", "\r\n\r\n")]


@pytest.fixture(scope="module")
def odd_pages(spark):
    return spark.createDataFrame([(*r, "r", 1, "s", "t") for r in ROWS], SCHEMA)


def files(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if n.endswith(".warc.gz")}


@pytest.mark.parametrize("min_bytes,hot,shard", [(0, 1000, 8 << 20), (9, 3, 2000), (100, 1000, 2000)])
def test_round_trip(spark, tmp_path, odd_pages, min_bytes, hot, shard, monkeypatch):
    monkeypatch.setattr(archives, "HOT_PAYLOADS", hot)
    monkeypatch.setattr(archives, "SHARD", shard)
    folder = f"file://{tmp_path}/out"
    listed = archives.write_archives(odd_pages, folder, min_bytes, roll=3000).collect()
    read = archives.read_archives(spark, folder)
    assert answers(read) == brute(ROWS, min_bytes)
    whole = {r["payload_digest"]: r["payload"] for r in read.where("record_type = 'response'").collect()}
    for _, _, html in ROWS:
        p = (html or "").encode()
        assert bytes(whole[b32encode(sha1(p).digest()).decode()]) == p
    assert sum(r["records"] for r in listed) == len(ROWS) and {r["file"] for r in listed} == set(files(f"{tmp_path}/out"))
    assert len(listed) > 3 and not os.path.exists(f"{tmp_path}/out/_temporary")
    urls = {r["page_id"]: r["url"] for r in read.collect()}
    assert urls[3] == ROWS[3][1] and urls[1000] == "http://x.org/%C3%A4%20b%0D%0AX-Page-ID:%207" and urls[1001] is None
    with pytest.raises(ValueError, match="exists"):
        archives.write_archives(odd_pages, folder)


def test_equal_tables_give_equal_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "SHARD", 2000)
    rows = [(i, "u", f"page {i % 90} " * 20) for i in range(600)]
    for name, parts in (("a", 1), ("b", 7)):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts, "page_id").sortWithinPartitions("page_id")
        archives.write_archives(pages.drop("row"), f"file://{tmp_path}/{name}", roll=2000)
    one, two = files(f"{tmp_path}/a"), files(f"{tmp_path}/b")
    assert list(one) == list(two) and len(one) > 5
    heads = [[line for line in gzip.decompress(x).split(b"\r\n") if line.startswith((b"X-Page-ID", b"WARC-Payload"))] for x in (b"".join(one.values()), b"".join(two.values()))]
    assert heads[0] == heads[1]
    archives.write_archives(pages, f"file://{tmp_path}/c", roll=2000)
    assert files(f"{tmp_path}/c") == two


def test_damage_and_strays(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/out"
    archives.write_archives(pages, folder)
    (name,) = files(f"{tmp_path}/out")
    whole = open(f"{tmp_path}/out/{name}", "rb").read()
    with open(f"{tmp_path}/out/stray.warc.gz", "wb") as f:  # no manifest lists it
        f.write(whole)
    assert archives.read_archives(spark, folder).count() == 50
    with open(f"{tmp_path}/out/{name}", "wb") as f:
        f.write(whole[:-40])
    with pytest.raises(Exception, match="differs from the manifest"):
        archives.read_archives(spark, folder).count()
    os.remove(f"{tmp_path}/out/{name}")
    with pytest.raises(ValueError, match="lacks files"):
        archives.read_archives(spark, folder)


def test_members_and_headers():
    good = archives.record("response", [("WARC-Record-ID", "<x>")], b"block")
    assert [archives.parsed(m)[1] for m in archives.members(good * 3)] == [b"block"] * 3
    with pytest.raises(ValueError, match="cut off"):
        list(archives.members(good + good[:30]))
    data = gzip.decompress(good)
    with pytest.raises(ValueError, match="digest"):
        archives.parsed(data.replace(b"block\r", b"blocK\r"))
    with pytest.raises(ValueError, match="long"):
        archives.parsed(data + b"x")


def test_query_and_empty_tables(spark, folder, tmp_path):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    assert answers(queries.op13_warc(spark, folder)) == brute(rows)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.write_archives(none, f"file://{tmp_path}/none").count() == 0
    assert archives.read_archives(spark, f"file://{tmp_path}/none").count() == 0
