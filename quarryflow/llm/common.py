"""Helpers shared by the corpus operators: durable cuts of lineage, word rules, small broadcast checks."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII blanks. bytes.split() without arguments splits by the same six.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is joined by broadcast only when it has at most so many rows; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 10_000
#: The names of a table's files are joined by broadcast up to so many, some 20 MB.
BROADCAST_FILES = 100_000

#: The tables kept so far by the innermost tidy function.
_made: ContextVar[list | None] = ContextVar("_made", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in a local session that names none (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-quarryflow-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", root)
        spark.sparkContext._jsc.sc().conf().set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared scratch folder and read it back.

    Later stages then start from files that outlive any executor, read only the columns they use, and never repeat
    the work before. The files go when the session ends. The collection afterwards lets Spark's cleaner remove the
    shuffle files of the finished part, which nothing refers to any more.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quarryflow/{name}-{uuid.uuid4().hex}"
    began = time.monotonic()
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    if time.monotonic() - began > 1:  # what was quick leaves little behind
        gc.collect()
        spark._jvm.System.gc()
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    if (made := _made.get()) is not None:
        made.append(kept)
    return kept


def discard(kept: DataFrame) -> None:
    """Remove the files of a kept table that nothing reads any more: all that was made from it is kept itself."""
    path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that return a kept table: whatever else they keep is removed when they are done."""

    @wraps(function)
    def run(*args, **options) -> DataFrame:
        outer, made = _made.get(), []
        token = _made.set(made)
        try:
            result = function(*args, **options)
        finally:
            _made.reset(token)
        for kept in made:  # those that have been discarded before are gone already, which does no harm
            if kept.kept_at != result.kept_at:
                discard(kept)
            elif outer is not None:
                outer.append(kept)
        return result

    return run


def numbered(docs: DataFrame, stored: bool = False) -> DataFrame:
    """docs as (doc, row): all columns as one struct, so no name can clash, and a number that tells rows apart.

    The number must be the same each time the table is read. stored says that docs are files read as they are; then it
    is the file's number and the place within the file, and nothing is written. Other tables are kept as a copy first.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    if not stored or "_metadata" in {c.lower() for c in docs.columns}:
        return keep(docs.select(whole, F.monotonically_increasing_id().alias("row")), "documents")
    files = sorted(r["p"] for r in docs.select(F.col("_metadata.file_path").alias("p")).distinct().collect())  # Spark's driver lists them anyway
    names = docs.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string")
    if len(files) <= BROADCAST_FILES:
        names = F.broadcast(names)
    found = docs.select(whole, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at")).join(names, "_path", "left")
    known = F.when(F.col("_file").isNull(), F.raise_error(F.lit("a file without a number"))).otherwise(F.col("_file"))
    return found.select("doc", (F.shiftleft(known, 36) + F.col("_at")).alias("row"))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark df for broadcast if it is known to have at most BROADCAST_ROWS rows. rows: the count, where it is known."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty. Lone surrogates, which Parquet cannot hold, are replaced."""
    return (text or "").encode("utf-8", "replace")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, whole and unchanged."""
    return text_bytes(text).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
