"""WARC archives of pages (operator 13): a deterministic sharded writer and its reader.

Pages go to shards by ranges of page_id. The bounds come from a sample that a hash of the id draws, at most some
SAMPLE ids whatever the table's size, weighed by their pages' bytes, so equal tables give equal shards on any cluster.
Each shard is sorted and written as a stream: one gzip member a record, a new file once a file has ROLL bytes.

A record's headers are made anew from the page: record id, lengths, digests of block and payload. Of pages with equal
payloads of at least min_bytes the one with the largest page_id (then url, then place) is written whole, the others as
revisits that refer to it. Payloads that only revisits have don't travel to the shards.

Tasks write under temporary names of their own and report them; a lost or repeated attempt leaves only files that no
report names. When all reports are kept, a second job gives the files their final names, which may be repeated at
any point, and the manifest (file, records, bytes, digest) is written last. Readers take the files that the manifest
lists and raise an error where size, digest, a header or a payload's digest differs.

The folder must lie in a store that Spark and pyarrow both open by the same URI (file, hdfs, s3, gs).

Defined cases: a null html is an empty payload; a null page_id comes before all others and is left out of the headers,
as is a null url; control characters, blanks and what isn't ASCII in a url are percent-encoded; repeated rows are
records of their own, one of them the response; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1, sha256
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.llm.common import discard, keep, numbered, scratch_root, small

#: Compressed bytes from which on the next record begins a new file.
ROLL = 64 << 20
#: Ids in the sample for the bounds, on average; bytes of html in a shard as long as there are few, and most shards until they reach SHARD_MOST.
SAMPLE, SHARD, SHARDS, SHARD_MOST = 65_536, 8 << 20, 512, 4 << 30
#: Payloads that hold 1 / HOT_PAYLOADS of all pages are joined by broadcast: at most so many.
HOT_PAYLOADS = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of content in one batch of read records.
BATCH = 8 << 20


def base32(digest: bytes) -> str:
    return b32encode(digest).decode()


def decided(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, row, payload (null for revisits), bytes, sha1 (hex), target (the response's page_id and row, for revisits)."""
    payload = F.coalesce(F.col("doc.html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("doc.page_id").cast("long").alias("page_id"), F.col("doc.url").alias("url"), "row", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("_same"))
    members = rows.where(F.col("bytes") >= min_bytes).select("_same", F.struct("page_id", "url", "row").alias("_at"))
    groups = members.groupBy("_same").agg(F.max("_at").alias("target"), F.count("*").alias("_n")).where("_n > 1")
    groups = keep(groups, "payloads")
    n = pages.count()
    hot, cold = groups.where(F.col("_n") * HOT_PAYLOADS >= n), groups.where(F.col("_n") * HOT_PAYLOADS < n)
    found = rows.join(F.broadcast(hot.select("_same", F.col("target").alias("_hot"))), "_same", "left")
    if not cold.isEmpty():
        # rows of hot payloads need no partner: a key of their own each keeps them apart
        key = F.when(F.col("_hot").isNull(), F.col("_same")).otherwise(F.col("row").cast("string"))
        found = found.withColumn("_same", key).join(cold.select("_same", F.col("target").alias("_cold")), "_same", "left")
    else:
        found = found.withColumn("_cold", F.lit(None).cast(groups.schema["target"].dataType))
    target = F.when(F.col("bytes") >= min_bytes, F.coalesce("_hot", "_cold"))
    target = F.when(target["row"] != F.col("row"), target)
    found = found.withColumn("target", target)
    return found.select("page_id", "url", "row", F.when(F.col("target").isNull(), F.col("payload")).alias("payload"), "bytes", "sha1", "target")


def shard_bounds(pages: DataFrame) -> list[int]:
    """Ascending ids; a shard begins at each. The same for equal tables."""
    size = F.coalesce(F.octet_length("doc.html"), F.lit(0)).cast("long")
    ids = pages.select(F.col("doc.page_id").cast("long").alias("page_id"), size.alias("size"))
    total = ids.agg(F.count("page_id").alias("n"), F.sum("size").alias("bytes")).head()
    shards = -(-(total["bytes"] or 0) // SHARD)
    shards = max(min(shards, SHARDS), -(-(total["bytes"] or 0) // SHARD_MOST))
    if shards < 2 or not total["n"]:
        return []
    one_of = max(1, total["n"] // SAMPLE)
    drawn = ids.where(F.pmod(F.xxhash64("page_id"), F.lit(one_of)) == 0).where("page_id IS NOT NULL").groupBy("page_id").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    drawn = drawn.orderBy("page_id").collect()
    passed = np.cumsum([r["size"] + r["n"] for r in drawn])
    at = np.searchsorted(passed, passed[-1] * np.arange(1, shards) / shards) if len(passed) else []
    return sorted({drawn[i]["page_id"] for i in at if i > 0})


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One gzip member with one WARC record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"WARC-Block-Digest: sha1:{base32(sha1(block).digest())}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def record_id(*names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, names)))}>"


def page_record(page_id, url, row, payload, size, digest, target) -> bytes:
    """The record of one page; target: (page_id, url, row) of the response that a revisit refers to."""
    digest = base32(bytes.fromhex(digest))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    place = lambda u: None if u is None else quote(u, safe="!#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\"")
    headers = [("WARC-Record-ID", record_id(page_id, row, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", place(url)), ("X-Page-ID", page_id)]
    if target is not None:
        headers += [("WARC-Refers-To", record_id(target["page_id"], target["row"], digest)), ("WARC-Refers-To-Target-URI", place(target["url"])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", target["page_id"]), ("WARC-Profile", PROFILE)]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    return record("response" if target is None else "revisit", headers, http + (payload if target is None else b""))


class _Rolling:
    """The files of one shard, written under temporary names; each closed file is reported."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.number, self.out = shard, roll, 0, None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.number:06d}.warc.gz"
            self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
            self.out, self.hash, self.bytes, self.records = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None), sha256(), 0, -1
            about = f"software: quarryflow\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.shard}\r\n".encode()
            self._write(record("warcinfo", [("WARC-Record-ID", record_id("info", self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))
        self._write(data)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1

    def full(self) -> bool:
        return self.out is not None and self.bytes >= self.roll

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.close()
        self.out, self.number = None, self.number + 1
        return [(self.name, self.temporary, self.records, self.bytes, self.hash.hexdigest())]


_REPORT = "file string, temporary string, records long, bytes long, sha256 string"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll: int = ROLL, stored: bool = False) -> DataFrame:
    """Write all pages under folder, which must not exist yet, and return the manifest: file, records, bytes, sha256."""
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path):
        raise ValueError(f"{folder} exists")
    store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary"))
    rows = numbered(pages, stored)
    bounds = shard_bounds(rows)
    shared = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(), side="right").astype("int32"))

    least = F.lit(-(2**63))  # a null would turn ids into floats
    dealt = decided(rows, min_bytes).withColumn("shard", shard_of(F.coalesce("page_id", least)))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "url", "row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for values in zip(*(part.column(c).to_pylist() for c in ("shard", "page_id", "url", "row", "payload", "bytes", "sha1", "target")), strict=True):
                    if out is None or out.shard != values[0]:
                        done += out.close() if out else []
                        out = _Rolling(folder, values[0], roll)
                    out.add(page_record(*values[1:]))
                    if out.full():
                        done += out.close()
            if done:
                yield _reported(done)
                done = []
        if out and (done := out.close()):
            yield _reported(done)

    reports = keep(dealt.mapInArrow(write, _REPORT), "reports")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                if where.get_file_info(f"{root}/{temporary}").type == fs.FileType.File:
                    where.move(f"{root}/{temporary}", f"{root}/{name}")
                elif where.get_file_info(f"{root}/{name}").type != fs.FileType.File:  # else an earlier attempt got so far
                    raise FileNotFoundError(f"{root}/{temporary}")
            yield batch

    named = reports.repartition(max(1, len(bounds) // 8 + 1)).mapInArrow(rename, _REPORT)
    named.select("file", "records", "bytes", "sha256").write.parquet(f"{folder}/_manifest")
    store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary"), True)
    discard(reports)
    return manifest(spark, folder)


def _reported(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "temporary", "records", "bytes", "sha256"])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/_manifest")


_HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def members(content: bytes) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one after the other."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpacker, out, start = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError(f"the gzip member at byte {start} is cut off")
            part = view[at : at + (1 << 16)]
            out.append(unpacker.decompress(part))
            at += len(part)
        at -= len(unpacker.unused_data)
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case names, and block of one WARC record; an error where lengths or digests differ."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(head.partition(b"\r\n")[2] + b"\r\n")}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('warc-record-id')} isn't as long as its header says")
    block = rest[:size]
    if headers["warc-block-digest"] != f"sha1:{base32(sha1(block).digest())}":
        raise ValueError(f"record {headers.get('warc-record-id')} has another block digest")
    return headers, block


def page_of(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of a response or revisit."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict((k.lower(), v) for k, v in _HEADER.findall(http.partition(b"\r\n")[2] + b"\r\n"))[b"content-length"])
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (len(payload) != size or base32(sha1(payload).digest()) != digest):
        raise ValueError(f"record {headers.get('warc-record-id')} has another payload")
    number = lambda c: int(headers[c]) if c in headers else None
    return number("x-page-id"), headers.get("warc-target-uri"), kind, size, digest, number("x-refers-to-page-id"), payload if kind == "response" else None


_PAGE = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The pages of all files that the manifest lists; payload is null for revisits, and for all without payloads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    names = manifest(spark, folder)
    if not names.join(files.select("file"), "file", "left_anti").isEmpty():
        raise ValueError(f"{folder} lacks files that its manifest lists")
    listed = files.join(small(names), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, records, digest = (batch.column(c)[i].as_py() for c in ("file", "records", "sha256"))
                content = batch.column("content")[i].as_py()
                if sha256(content).hexdigest() != digest:
                    raise ValueError(f"{name} differs from the manifest")
                pages, held, found = [], 0, 0
                for data in members(content):
                    headers, block = parsed(data)
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    found += 1
                    page = page_of(headers, block)
                    pages.append(page if payloads else (*page[:-1], None))
                    held += len(block) if payloads else 256
                    if held > BATCH:
                        yield _pages(pages)
                        pages, held = [], 0
                if found != records:
                    raise ValueError(f"{name} has {found} records, not {records}")
                yield _pages(pages)

    return listed.mapInArrow(read, _PAGE)


def _pages(pages: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pages, strict=True)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=[c.split(" ")[0] for c in _PAGE.split(", ")])


def scratch_folder(spark: SparkSession) -> str:
    """A folder of its own under the shared scratch folder, removed when the session ends."""
    folder = f"{scratch_root(spark)}/quarryflow/archives-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
