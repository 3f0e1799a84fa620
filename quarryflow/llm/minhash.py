"""Near-duplicate documents by fast similarity sketches, banding and exact verification (operator 1).

A sketch has t coordinates. Round i < t throws each element into one random bin with a random value; rounds t to
2t - 1 throw every element into bin i - t. A coordinate is the least (round, value) that fell into it, and the rounds
end when every bin is full, so a long document needs one or two rounds and a short one still fills all coordinates. A
coordinate of two sets agrees with probability equal to their Jaccard similarity, and the share of agreeing coordinates
is concentrated around it. BANDS choices of ROWS coordinates each bring a pair of similarity 0.8 together but for a chance
of 5 in a million, and texts with only a passage in common rarely. Pairs from bands are confirmed on the full sets.

Documents with equal words are one class from the start, so copies, however many, are one node. Links within a bucket
are found as components.linked_within_buckets says.

Defined cases: null and empty texts have no shingles and are linked with nothing; a document with fewer words than a
shingle has its whole sequence as the one shingle; rows with a null doc_id take no part and are kept; repeated rows are
copies of each other; an empty table gives no rows; other columns are untouched and may have any name.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quarryflow.llm.common import keep, numbered, text_bytes, tidy
from quarryflow.llm.components import Dense, crowds, linked_within_buckets, with_contents

COORDINATES = 128
BANDS, ROWS = 40, 6
#: Buckets of more members that stay apart are compared by blocks.
CROWD = 16
_BITS = COORDINATES.bit_length() - 1
_U = np.uint64
_SEEDS = np.random.default_rng(1).integers(1, 2**63, 2 * COORDINATES, dtype=np.uint64)
_CHOICES = np.stack([np.random.default_rng([3, i]).choice(COORDINATES, ROWS, replace=False) for i in range(BANDS)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_words(text: str | None) -> list[bytes]:
    return text_bytes(text).lower().split()  # bytes.lower() changes A-Z alone


def shingles(words: list[bytes], k: int) -> set:
    """The exact shingle set, for verification."""
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else ({tuple(words)} if words else set())


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        total = mixed(total + h[i : i + n])
    return np.unique(total)


def sketch(elements: np.ndarray) -> np.ndarray:
    """COORDINATES values of a non-empty set of 64-bit hashes; the round is in the top byte."""
    t = COORDINATES
    filled = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    at, many = 0, max(1, -(-4 * t // len(elements)))
    while at < t:
        rounds = np.arange(at, min(t, at + many), dtype=np.uint64)
        x = mixed(elements[None, :] ^ _SEEDS[rounds][:, None])
        np.minimum.at(filled, (x >> _U(64 - _BITS)).ravel(), ((x & _U((1 << 56) - 1)) | (rounds[:, None] << _U(56))).ravel())
        if filled.max() < np.iinfo(np.uint64).max:
            return filled
        at += many
    for j in np.flatnonzero(filled == np.iinfo(np.uint64).max):
        filled[j] = (mixed(elements ^ _SEEDS[t + j]) & _U((1 << 56) - 1)).min() | _U(t + j) << _U(56)
    return filled


def folded(filled: np.ndarray) -> bytes:
    """Two bytes of each coordinate; unequal ones agree there with a chance of 1 in 65,536."""
    return mixed(filled).astype("<u2").tobytes()


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(documents, COORDINATES) folded sketches to (documents, BANDS) keys."""
    total = np.arange(BANDS, dtype=np.uint64)[None, :] + _U(1)
    for column in _CHOICES.T:
        total = mixed(total * _U(0x9E3779B97F4A7C15) + sketches[:, column])
    return total.view(np.int64)


def signature(text: Column, k: int) -> Column:
    """struct<n_shingles, words (digest of the word sequence), sketch>; sketch is null without shingles."""

    @F.pandas_udf("n_shingles long, words binary, sketch binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = shingle_words(text)
                found = shingle_hashes(words, k) if words else ()
                rows.append((len(found), blake2b(b" ".join(words), digest_size=16).digest(), folded(sketch(found)) if len(found) else None))
            yield pd.DataFrame(rows, columns=["n_shingles", "words", "sketch"])

    return sign(text)


def banded(classes: DataFrame) -> DataFrame:
    """(bucket, node, size): one row for each key of each class's sketch. classes: (row, size, sketch)."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                buckets = band_keys(np.frombuffer(b"".join(part.column("sketch").to_pylist()), "<u2").reshape(-1, COORDINATES))
                node, size = (np.repeat(part.column(c).to_numpy(), BANDS) for c in ("row", "size"))
                yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(node), pa.array(size)], names=["bucket", "node", "size"])

    return classes.select("row", "size", "sketch").mapInArrow(band, "bucket long, node long, size long")


def similar_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets. texts: (node, content)."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, set] = OrderedDict()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for i, row in enumerate(a):
                if row not in known:
                    known[row] = shingles(shingle_words(batch.column("content_a")[i].as_py()), k)
                    if len(known) > 32:
                        known.popitem(last=False)
                one, two = known[row], shingles(shingle_words(batch.column("content_b")[i].as_py()), k)
                common = len(one & two)
                if 100 * common >= percent * (len(one) + len(two) - common):
                    good.append(i)
            yield pa.RecordBatch.from_pydict({"a": [a[i] for i in good], "b": [b[i] for i in good]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return with_contents(pairs, texts).mapInArrow(confirm, "a long, b long")


@tidy
def document_groups(rows: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """row, doc_id, n_shingles, component_id and first of each of rows (row, doc_id, text), kept.

    rows are the same at each reading (common.numbered). component_id is the smallest doc_id of the document's group;
    first marks exactly one row of each group.
    """
    signed = rows.select("row", "doc_id", signature(F.col("text"), k).alias("s"))
    signed = keep(signed.select("row", "doc_id", "s.n_shingles", "s.words", "s.sketch"), "signed")

    linkable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linkable.groupBy("words").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size"))
    classes = keep(classes.select("words", F.col("least.doc_id").alias("doc_id"), F.col("least.row").alias("row"), "sketch", "size"), "classes")

    shared = crowds(banded(classes))
    wanted = shared.select(F.col("node").alias("row")).distinct()
    texts = keep(rows.select("row", "text").join(wanted, "row", "left_semi").toDF("node", "content"), "texts")

    def linked(one: set, two: set) -> bool:
        if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
            return False
        common = len(one & two)
        return 100 * common >= percent * (len(one) + len(two) - common)

    dense = Dense(texts, lambda text: shingles(shingle_words(text), k), linked, CROWD)
    roots = linked_within_buckets(shared, lambda pairs: similar_pairs(pairs, texts, k, percent), lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b), dense)
    named = classes.select("words", "doc_id", "row").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    groups = keep(named.join(least, "root").select("words", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("_first")), "groups")

    ids = signed.drop("sketch").withColumn("words", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("words")))
    out = ids.join(groups, "words", "left")
    first = F.coalesce("_first", "row") == F.col("row")
    return keep(out.select("row", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), first.alias("first")), "near")


def group_documents(docs: DataFrame, k: int = 5, percent: int = 80, stored: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id and first, as document_groups gives them."""
    rows = numbered(docs, stored)
    return document_groups(rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")), k, percent)


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, stored: bool = False) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with its columns."""
    rows = numbered(docs, stored)
    groups = document_groups(rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")), k, percent)
    return rows.join(groups.where("NOT first").select("row"), "row", "left_anti").select("doc.*")
