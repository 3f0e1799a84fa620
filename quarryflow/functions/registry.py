"""Table functions in Python over Arrow batches, registered under the names that SQL calls them by."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: name: table function. Each takes a table, batch by batch, wherever its rows lie.
TABLE_FUNCTIONS: dict[str, Callable] = {}


def table_function(name: str, returns: str) -> Callable:
    """Put a class with eval() over Arrow arrays into the registry."""

    def put(cls: type) -> type:
        TABLE_FUNCTIONS[name] = lambda: F.arrow_udtf(cls, returnType=returns)
        return cls

    return put


def register(spark: SparkSession) -> None:
    """Register all table functions for this session's SQL."""
    for name, make in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, make())


@table_function("sentences_of", "lang string, place int, sentence string, words int")
class Sentences:
    """sentences_of(TABLE(t)): the sentences of t's texts, cut after . ! or ? and blanks, with lang; null and blank texts have none."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        split = [[s for s in re.split(r"(?<=[.!?])[ \t\n\r]+", text or "") if s.strip(" \t\n\r")] for text in batch.column("text").to_pylist()]
        lang = [x for x, found in zip(batch.column("lang").to_pylist(), split, strict=True) for _ in found]
        place, flat = [k for found in split for k in range(len(found))], [s for found in split for s in found]
        words = [len(re.findall(r"[^ \t\n\r]+", s)) for s in flat]
        yield pa.table({"lang": pa.array(lang, pa.string()), "place": pa.array(place, pa.int32()), "sentence": pa.array(flat, pa.string()), "words": pa.array(words, pa.int32())})
