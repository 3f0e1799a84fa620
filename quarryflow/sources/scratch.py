"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a local session that names none (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own there, removed when the session ends."""
    folder = f"{shared_folder(spark)}/quarryflow/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def file_by_file(spark: SparkSession, folder: str, schema: StructType, rows: int) -> DataFrame:
    """A Parquet folder with each file as a part of its own, so parts are as large as they were written, read so many rows at once.

    Spark would otherwise read many files of few bytes in one task, however many rows these bytes stand for, and 4096 rows
    at once, however long their lists. It is told so in a session of its own, since both are settings.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
    session.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))
    return session.read.schema(schema).parquet(folder)
