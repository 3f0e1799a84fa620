"""Vector code compression by product codebooks and delta-maintained Lloyd rounds (operator 12).

Components become whole numbers, vectors are cut into equal parts, and each part position has a codebook. A round
assigns every part to its nearest entry and moves each entry to the mean of its parts. Between rounds the assignments
are kept as a table and the entries' whole-number sums and counts on the driver (entries * dimensions numbers): a task
compares its parts' new assignments with those kept, adds a part whose assignment changed to its new entry's sum and
takes it from the old one's, and only these differences, one row for each entry that changed in the task, are shuffled.

The vectors are written once, dealt by row into buckets, and a round reads them beside the bucket of their assignments,
without moving them.

Defined cases: vectors that are null, empty, hold null or non-finite components, have another length than most (of
equally frequent lengths the largest) or one that can't be cut into so many parts, or hold components so large that a
squared distance may not fit a long, are dropped; with fewer vectors than entries every one is an entry; null vec_ids
come after all others, and equal ones follow each other by their components; repeated rows are vectors of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.llm.common import discard, keep, scratch_root

#: Rows of a label, as a share of all, from which on its sum is joined by broadcast: at most so many labels have it.
HOT_LABELS = 1000
#: Bytes of vectors in a bucket.
BUCKET = 64 << 20
#: Vectors that are compared with a codebook at once.
BLOCK = 4096


def whole_numbers(table: DataFrame, vector: str, scale: int, parts: int) -> DataFrame:
    """vec_id, label, v: the vectors that take part, as whole numbers floor(scale * x)."""
    present = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale))
    limit = lambda x: F.abs(x.cast("double") * scale) * F.sqrt(F.size(vector)) < 2.0**29
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.coalesce(present, F.lit(False))
    usable = usable & F.coalesce(F.forall(vector, limit), F.lit(False))
    return table.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.transform(scaled, lambda x: x.try_cast("int")).alias("v"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower, and the squared distance; exact."""
    codes, errors = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    small = 4.0 * max(1, x.shape[1]) * float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))) ** 2 < 2.0**52
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        if small:  # all sums are whole numbers that a double holds
            y, b = part.astype(float), book.astype(float)
            d = (b * b).sum(1)[None, :] - 2 * (y @ b.T)
            best = d.argmin(1)
        else:
            best = np.concatenate([((row[None, :] - book) ** 2).sum(1).argmin(keepdims=True) for row in part])
        codes[at : at + BLOCK] = best
        errors[at : at + BLOCK] = ((part - book[best]) ** 2).sum(1)
    return codes, errors


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


class Bucketed:
    """A table written by buckets of row, under the shared scratch folder; discard() removes it."""

    def __init__(self, df: DataFrame, buckets: int, name: str, dealt: bool = False):
        """dealt: each task of df holds rows of few buckets already, so nothing need move."""
        self.spark: SparkSession = df.sparkSession
        self.buckets = buckets
        self.name = f"quarryflow_{name}_{uuid.uuid4().hex}"
        self.path = f"{scratch_root(self.spark)}/quarryflow/{self.name}"
        df = df if dealt else df.repartition(buckets, "row")
        df.write.format("parquet").bucketBy(buckets, "row").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def discard(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _beside(vectors: Bucketed, codes: Bucketed) -> DataFrame:
    """Vectors with their kept codes: both lie in the same buckets, so neither moves."""
    kept = codes.df.where("codes IS NOT NULL").select("row", "codes").hint("shuffle_hash")
    return vectors.df.select("row", "v").join(kept, "row")


_ROUND = "row long, codes array<int>, part int, entry int, place int, total long"


def _added(total: np.ndarray, codes: np.ndarray, values: np.ndarray, sign: int) -> None:
    """Add the rows of values to the rows of total that codes name, or take them off."""
    if len(codes):
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        total[codes[first]] += sign * np.add.reduceat(values[order], first, axis=0)


def one_round(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """The new codes of each row; after a task's last row, what its changed assignments add to sums or take from them.

    vectors: row, v and, from the second round on, codes as kept. A difference is (part, entry, place, total), place 0
    being the count; it goes by a row of the task, so it lies in that row's bucket.
    """
    parts, entries, width = books.shape
    again = "codes" in vectors.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, row = np.zeros((parts, entries, width + 1), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, row = _matrix(batch.column("v"), parts * width), batch.column("row")
            old = _matrix(batch.column("codes"), parts) if again else None
            new = np.zeros((len(x), parts), np.int64)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                new[:, p] = nearest(part, books[p])[0]
                moved = np.flatnonzero(new[:, p] != old[:, p]) if again else np.arange(len(x))
                values = np.concatenate((np.ones((len(moved), 1), np.int64), part[moved]), axis=1)
                _added(total[p], new[moved, p], values, 1)
                if again:
                    _added(total[p], old[moved, p], values, -1)
            none = [pa.nulls(len(x), pa.int32())] * 3 + [pa.nulls(len(x), pa.int64())]
            yield pa.RecordBatch.from_arrays([row, _lists(new), *none], names=_NAMES)
        p, entry, place = np.nonzero(total)
        if len(p):
            columns = [pa.array(np.full(len(p), row[-1].as_py())), pa.nulls(len(p), pa.list_(pa.int32()))]
            columns += [pa.array(c, pa.int32()) for c in (p, entry, place)] + [pa.array(total[p, entry, place])]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return vectors.mapInArrow(read, _ROUND)


_NAMES = ["row", "codes", "part", "entry", "place", "total"]


def _lists(codes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel(), pa.int32()))


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes and error, the squared distance summed over parts."""
    parts, _, width = books.shape

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), parts * width)
            found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            columns = [batch.column("vec_id"), batch.column("label"), _lists(np.stack([c for c, _ in found], axis=1)), pa.array(sum(e for _, e in found))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "codes", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(read, f"vec_id long, label {kind}, codes array<int>, error long")


def trained(vectors: Bucketed, books: np.ndarray, rounds: int) -> tuple[np.ndarray, list[int]]:
    """The codebooks after so many rounds, and how many parts each round found to have changed their entry."""
    sums, before, moves = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64), None, []
    for _ in range(rounds):
        now = Bucketed(one_round(_beside(vectors, before) if before else vectors.df.select("row", "v"), books), vectors.buckets, "codes", dealt=True)
        changed = now.df.where("part IS NOT NULL").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
        moves.append(0)
        for r in changed.collect():  # entries * (dimensions + parts) at most
            sums[r["part"], r["entry"], r["place"]] += r["total"]
            moves[-1] += max(0, r["total"]) if r["place"] == 0 else 0
        if before:
            before.discard()
        before = now
        used = sums[:, :, 0] > 0
        books = books.copy()
        books[used] = np.floor_divide(sums[used][:, 1:], sums[used][:, :1])
    if before:
        before.discard()
    return books, moves


def compress(table: DataFrame, vector: str = "embedding", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): vec_id, label, codes, error and label_error of each vector; (parts, entries, width)."""
    whole = keep(whole_numbers(table, vector, scale, parts).withColumn("row", F.monotonically_increasing_id()), "whole")
    usual = whole.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).head()
    dims, n = (usual["dims"], usual["n"]) if usual else (parts, 0)
    first = whole.where(F.size("v") == dims).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    if not n:
        return whole.limit(0).select("vec_id", "label", F.array(F.lit(0)).alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    buckets = max(-(-n * dims * 4 // BUCKET), min(-(-n // BLOCK), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    vectors = Bucketed(whole.where(F.size("v") == dims), buckets, "vectors")
    discard(whole)
    books, _ = trained(vectors, books, rounds)
    rows = keep(coded(vectors.df, books), "coded")
    vectors.discard()
    return with_label_errors(rows, n), books


def with_label_errors(rows: DataFrame, n: int) -> DataFrame:
    """rows with label_error. The sums of labels that hold 1 / HOT_LABELS of all rows are joined by broadcast."""
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n"))
    hot, same = F.broadcast(sums.where(F.col("_n") * HOT_LABELS >= n)), F.col("label").eqNullSafe(F.col("_label"))
    common = rows.join(hot, same)
    rest = rows.join(hot.select("_label"), same, "left_anti").join(sums.where(F.col("_n") * HOT_LABELS < n), same)
    return common.union(rest).drop("_label", "_n")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
