"""Merge, update and delete over a folder of Parquet files, rewriting only files that hold a row concerned.

Spark finds those files by a join on keys that returns file names; their new content is written to a staging folder
beside the table, an intent file names what comes and what goes, and the files change places. Whoever writes next
finishes an intent that was left behind, so a driver that fails anywhere loses and repeats nothing. A token marks a
change as done; the same token again changes nothing. Readers must not read while files change places.

Defined cases: null keys are keys like others; of source rows with equal keys the latest by order counts, ties going to
the least hash of the row; a table without files takes all of source; conditions that are null concern no row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryflow.operators.incremental import update, without

INTENT, DONE = "_intent.json", "_done"


class _Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.exists(name) else []

    def put(self, name: str, text: str) -> None:
        out = self.fs.create(self.at(name), False)  # an error if it is there
        out.write(bytearray(text.encode()))
        out.close()

    def get(self, name: str) -> str:
        opened = self.fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        finally:
            opened.close()


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table's rows; schema is needed only while the table may have no files."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("_file", F.col("_metadata.file_name"))


def touched_files(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> list[str]:
    """The names of target's files that hold a key of source; as many as files at most reach the driver.

    Only keys are read, and of those only row groups within the range of source's first key.
    """
    lead = keys[0]
    lo, hi = source.agg(F.min(lead), F.max(lead)).head()
    near = _with_file(target).select(*keys, "_file")
    if lo is not None:
        near = near.where(F.col(lead).between(F.lit(lo), F.lit(hi)) | F.col(lead).isNull())
    held = source.select(*(F.col(k).alias(f"_held_{k}") for k in keys)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in keys))
    return sorted(r["_file"] for r in near.join(held, same, "left_semi").select("_file").distinct().collect())


def finish(spark: SparkSession, path: str) -> None:
    """Carry out an intent that was left behind. Each step may be repeated."""
    store = _Store(spark, path)
    if store.exists(INTENT):
        intent = json.loads(store.get(INTENT))
        for name in store.names(intent["staged"]):
            if name.endswith(".parquet"):
                store.fs.rename(store.at(f"{intent['staged']}/{name}"), store.at(f"{intent['token']}-{name}"))
        for name in intent["gone"]:
            store.fs.delete(store.at(name), False)
        if not store.exists(f"{DONE}/{intent['token']}"):
            store.put(f"{DONE}/{intent['token']}", "")
        store.fs.delete(store.at(intent["staged"]), True)
        store.fs.delete(store.at(INTENT), False)
    for name in store.names(""):  # staged by a writer that failed before its intent
        if name.startswith("_staged-"):
            store.fs.delete(store.at(name), True)


def replace_files(spark: SparkSession, path: str, gone: Sequence[str], rows: DataFrame, token: str | None = None) -> None:
    """The files named in gone leave the table, rows come; all other files stay as they are."""
    store, token = _Store(spark, path), token or uuid.uuid4().hex
    staged = f"_staged-{uuid.uuid4().hex}"
    rows.write.parquet(f"{store.path}/{staged}")
    store.put(INTENT, json.dumps({"staged": staged, "gone": list(gone), "token": token}))
    finish(spark, path)


def is_done(spark: SparkSession, path: str, token: str) -> bool:
    return _Store(spark, path).exists(f"{DONE}/{token}")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order."""
    turn = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order), F.xxhash64(*rows.columns))
    return rows.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn")


def merge_files(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], order: Sequence[str], token: str | None = None, newest: bool = False) -> list[str]:
    """Upsert source's latest row of each key; returns the names of the files that were rewritten.

    newest: a row of the table that is later by order stays, so late or repeated source rows do no harm.
    """
    store = _Store(spark, path)
    store.fs.mkdirs(store.at(""))
    finish(spark, path)
    if token and is_done(spark, path, token):
        return []
    target = read(spark, path, source.schema)
    gone = touched_files(target, source, keys)
    old = _with_file(target).where(F.col("_file").isin(gone)).drop("_file") if gone else target.limit(0)
    new = latest(source, keys, order)
    rows = latest(old.unionByName(new), keys, order) if newest else without(old, new, keys).unionByName(new)
    replace_files(spark, path, gone, rows, token)
    return gone


def _concerned(spark: SparkSession, path: str, condition: Column) -> tuple[list[str], DataFrame]:
    finish(spark, path)
    target = _with_file(read(spark, path))
    gone = sorted(r["_file"] for r in target.where(condition).select("_file").distinct().collect())
    return gone, target.where(F.col("_file").isin(gone)).drop("_file")


def update_files(spark: SparkSession, path: str, condition: Column, values: dict[str, Column]) -> list[str]:
    """UPDATE path SET values WHERE condition; returns the names of the files that were rewritten."""
    gone, rows = _concerned(spark, path, condition)
    if gone:
        replace_files(spark, path, gone, update(rows, condition, values))
    return gone


def delete_files(spark: SparkSession, path: str, condition: Column) -> list[str]:
    """DELETE FROM path WHERE condition; returns the names of the files that were rewritten."""
    gone, rows = _concerned(spark, path, condition)
    if gone:
        replace_files(spark, path, gone, rows.where(~F.coalesce(condition, F.lit(False))))
    return gone
