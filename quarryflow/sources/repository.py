"""SQL repositories, zip archives and pair files as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that a scan reads, and folders that it passes over.
SUFFIXES = (".sql", ".hql", ".ddl", ".dml", ".yml", ".yaml", ".py")
SKIPPED = (".git", ".svn", "node_modules", "__pycache__", ".venv", "venv", "target", "dbt_packages", ".dbt", "dist", "build")


def _wanted(path: F.Column) -> F.Column:
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$") & ~path.rlike("(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, source_sql, lines, bytes of every wanted file that isn't blank. Bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    text = files.where(_wanted(F.col("path"))).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("source_sql"), F.col("length").alias("bytes"))
    lines = F.length("source_sql") - F.length(F.replace("source_sql", F.lit("\n"), F.lit(""))) + 1
    return text.where(F.trim("source_sql") != "").withColumn("lines", lines)


def scan_zip(spark: SparkSession, pattern: str) -> DataFrame:
    """The same from zip archives; entries are read in memory, one archive a row, and never unpacked to disk."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for entry in archive.infolist():
                        if not entry.is_dir():
                            raw = archive.read(entry)
                            yield pd.DataFrame({"path": [f"{path}!/{entry.filename}"], "source_sql": [raw.decode("utf-8", "replace")], "bytes": [len(raw)]})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    found = files.mapInPandas(entries, "path string, source_sql string, bytes long")
    lines = F.length("source_sql") - F.length(F.replace("source_sql", F.lit("\n"), F.lit(""))) + 1
    return found.where(_wanted(F.col("path")) & (F.trim("source_sql") != "")).withColumn("lines", lines)


def scan(spark: SparkSession, path: str) -> DataFrame:
    return scan_zip(spark, path) if path.lower().endswith(".zip") else scan_folder(spark, path)


def read_pairs(spark: SparkSession, path: str, limit: int | None = None, category: str | None = None) -> DataFrame:
    """Pairs of predicted and gold SQL from JSON lines; blank lines are none.

    limit: read at most so many; category: of those that were read, only the pairs of this category.
    """
    pairs = spark.read.schema("id string, category string, source_dialect string, target_dialect string, source_sql string, target_sql string, notes string").json(path)
    if limit is not None:
        pairs = pairs.limit(limit)
    return pairs if category is None else pairs.where(F.col("category") == category)


def sample_table(spark: SparkSession, columns: dict[str, str], rows: int = 5) -> DataFrame:
    """A small table for trials. columns: name to kind (date, id, amount, name, other); the first amount is null."""
    n = F.col("id")
    kinds = {
        "date": F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")),
        "id": n + 1,
        "amount": F.when(n > 0, (n * 10.5).cast("decimal(18,2)")),
        "name": F.concat(F.lit("name_"), n.cast("string")),
        "other": F.concat(F.lit("v"), n.cast("string")),
    }
    return spark.range(rows).select(*(kinds[kind].alias(name) for name, kind in columns.items()))


def append_leaderboard(board: DataFrame, entry: DataFrame, keep: int = 50) -> DataFrame:
    """The board with new entries, best first by pass rate and token F1, cut to keep."""
    return board.unionByName(entry).orderBy(F.desc("pass_rate"), F.desc("token_f1"), "name").limit(keep)
