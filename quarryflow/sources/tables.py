"""Parquet tables of a data folder, and SQL over them without any registered names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def run_sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Run SQL whose tables stand in braces, as in SELECT * FROM {orders}; each becomes a scan of that table.

    Nothing is registered in the catalog, so queries over different folders never see each other's tables.
    """
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{name: table(spark, folder, name) for name in names})


def plain_sql(text: str) -> str:
    """The same SQL with bare table names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)
