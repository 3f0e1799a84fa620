"""A risk class for SQL texts, learnt from labelled ones: character n-grams, TF-IDF and a balanced logistic regression.

The n-grams of a text are made three times in all: to count them, for the vectors that the regression reads from files,
and where a text is judged. Of strings in rows there would be thousands a text, made anew for each length and stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarryflow.operators.graph import cut
from quarryflow.sources.scratch import fresh_folder, file_by_file

#: Lengths of n-grams, least number of texts that hold one, and size of the vocabulary of each length.
LENGTHS, LEAST_TEXTS, VOCABULARY = (3, 4, 5), 2, 4000
#: What is high risk whatever the model says, and the probabilities it then has, by class.
HARD = r"(?i)EXECUTE\s+IMMEDIATE|\bCURSOR\b|\bCONNECT\s+BY\b|EXCEPTION\s+WHEN"
HARD_PROBABILITIES = {"low": 0.05, "medium": 0.15, "high": 0.80}
#: Characters whose n-grams are made at once, and texts whose counts are held as a matrix at once.
CHARACTERS, TEXTS = 1_000_000, 128
#: Characters of texts in a part, at most and, if there are tasks without a part, at least. Vectors take some ten times as
#: many bytes in memory, and the regression holds whole parts.
LARGEST, LEAST = 8_000_000, 500_000
#: An n-gram's number: its characters as digits to this base, modulo 2 ** 64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class RiskModel:
    """labels by class number; numbers of the vocabulary's n-grams by length, ascending; weights (n-grams, classes), with
    the inverse document frequencies in them; intercepts by class."""

    labels: list[str]
    numbers: list[np.ndarray]
    weights: np.ndarray
    intercepts: np.ndarray


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+", " ")


def _grams(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and start of each n-gram within one text. owner: the text of each character."""
    starts = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1]) if len(codes) >= n else np.zeros(0, np.int64)
    total = np.zeros(len(starts), np.uint64)
    for k in range(n):
        total = total * _BASE + codes[starts + k]
    return total, starts


def _parts(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Places of some texts, all their characters, and each character's text, counted from the first of these."""
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= CHARACTERS):
            held += len(texts[stop])
            stop += 1
        codes = np.frombuffer("".join(texts[at:stop]).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        yield list(range(at, stop)), codes, np.repeat(np.arange(stop - at), [len(t) for t in texts[at:stop]])
        at = stop


def vocabulary(texts: DataFrame) -> dict[int, list[tuple[str, int]]]:
    """By length, the n-grams with the most occurrences and how many texts hold each. texts: (plain)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes, owner in _parts(batch.column("plain").to_pylist()):
                for n in LENGTHS:
                    numbers, starts = _grams(codes, owner, n)
                    if not len(numbers):
                        continue
                    _, first, which, times = np.unique(numbers, return_index=True, return_inverse=True, return_counts=True)
                    pairs = np.sort(which * np.int64(int(owner[-1]) + 1) + owner[starts])
                    once = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] // (int(owner[-1]) + 1)
                    grams = [codes[s : s + n].astype("<u4").tobytes().decode("utf-32-le") for s in starts[first].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(grams), pa.int32()), pa.array(grams, pa.string()), pa.array(times, pa.int64()), pa.array(np.bincount(once, minlength=len(grams)), pa.int64())], names=["n", "gram", "times", "texts"])

    counted = texts.mapInArrow(count, "n int, gram string, times long, texts long").groupBy("n", "gram").agg(F.sum("times").alias("times"), F.sum("texts").alias("texts"))
    counted = cut(counted.where(F.col("texts") >= LEAST_TEXTS))
    best = {n: counted.where(F.col("n") == n).orderBy(F.desc("times"), "gram").limit(VOCABULARY).select("gram", "texts").collect() for n in LENGTHS}  # VOCABULARY rows each
    return {n: [(r["gram"], r["texts"]) for r in rows] for n, rows in best.items()}


def _counts(texts: list[str], numbers: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places of some texts and the matrix of their counts of the vocabulary's n-grams."""
    ends = np.cumsum([0, *map(len, numbers)])
    for at in range(0, len(texts), TEXTS):
        for places, codes, owner in _parts(texts[at : at + TEXTS]):
            matrix = np.zeros((len(places), int(ends[-1])), np.int64)
            for n, known, begin, end in zip(LENGTHS, numbers, ends[:-1], ends[1:], strict=True):
                found, starts = _grams(codes, owner, n)
                if len(known) and len(found):
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    held = known[place] == found
                    cells = owner[starts[held]] * len(known) + place[held]
                    matrix[:, begin:end] = np.bincount(cells, minlength=len(places) * len(known)).reshape(len(places), -1)
            yield [at + p for p in places], matrix


def parts(characters: int, tasks: int) -> int:
    """How many parts texts of so many characters are dealt to. By their bytes in files, which like texts make few, a part would have any number."""
    return max(1, -(-characters // LARGEST), min(tasks, -(-characters // LEAST)))


def fit(labelled: DataFrame, text: str = "source_sql", label: str = "level") -> RiskModel:
    """labelled: texts with a class. Classes weigh alike, however many rows they have."""
    spark = labelled.sparkSession
    found = labelled.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("characters")).collect()  # one row a class
    counts = {r["label"]: r["n"] for r in found}
    total, labels = sum(counts.values()), sorted(counts)
    n = parts(sum(r["characters"] or 0 for r in found), int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = fresh_folder(spark, "texts")
    dealt = labelled.select(F.col(label).alias("label"), plain(F.col(text)).alias("plain")).repartition(n)
    dealt.write.option("compression", "zstd").parquet(folder)
    rows = file_by_file(spark, folder, dealt.schema, TEXTS)
    words = vocabulary(rows.select("plain"))
    # by number, since texts are looked up so
    number = lambda gram: int(_grams(np.frombuffer(gram.encode("utf-32-le"), "<u4").astype(np.uint64), np.zeros(len(gram), np.int64), len(gram))[0][0])
    known = {n: sorted((number(gram), held) for gram, held in found) for n, found in words.items()}
    numbers = [np.array([k for k, _ in known[n]], np.uint64) for n in LENGTHS]
    idf = np.log((total + 1) / (np.array([held for n in LENGTHS for _, held in known[n]], np.float64) + 1))
    classes = {c: (float(k), total / (len(counts) * counts[c])) for k, c in enumerate(labels)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("label").to_pylist()
            for places, matrix in _counts(batch.column("plain").to_pylist(), numbers):
                which, at = np.nonzero(matrix)
                sizes = pa.array(np.searchsorted(which, np.arange(len(places) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(sizes, pa.array(at, pa.int32())), pa.ListArray.from_arrays(sizes, pa.array(matrix[which, at] * idf[at], pa.float64()))]
                fixed = [pa.array([0] * len(places), pa.int8()), pa.array([len(idf)] * len(places), pa.int32())]
                features = pa.StructArray.from_arrays([*fixed, *lists], names=["type", "size", "indices", "values"])
                own = [classes[kinds[p]] for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own]), pa.array([w for _, w in own]), features], names=["label", "weight", "features"])

    folder = fresh_folder(spark, "vectors")
    held = rows.mapInArrow(vectors, "label double, weight double, features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>")
    held.write.option("compression", "zstd").parquet(folder)
    schema = StructType([StructField("label", DoubleType()), StructField("weight", DoubleType()), StructField("features", VectorUDT())])
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=20, regParam=0.01).fit(file_by_file(spark, folder, schema, TEXTS))
    weights, intercepts = model.coefficientMatrix.toArray().T, model.interceptVector.toArray()
    if weights.shape[1] == 1:  # two classes: the second's odds
        weights, intercepts = np.hstack([0 * weights, weights]), np.array([0.0, intercepts[0]])
    return RiskModel(labels, numbers, weights * idf[:, None], intercepts)


def predict(model: RiskModel, objects: DataFrame, text: str = "source_sql") -> DataFrame:
    """objects with predicted (class), hard (whether a hard pattern decided) and probabilities (class to probability)."""
    labels, numbers, weights, intercepts = model.labels, model.numbers, model.weights, model.intercepts

    @F.pandas_udf("array<double>")
    def judged(texts):  # noqa: ANN001, ANN202
        out = [None] * len(texts)
        for places, matrix in _counts(texts.tolist(), numbers):
            odds = matrix @ weights + intercepts
            chances = np.exp(odds - odds.max(axis=1, keepdims=True))
            for p, row in zip(places, chances / chances.sum(axis=1, keepdims=True), strict=True):
                out[p] = row
        return texts.__class__(out, dtype=object)

    names = F.array(*map(F.lit, labels))
    tasks = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = objects.repartition(tasks).withColumn("_chances", judged(plain(F.col(text))))
    hard = F.col(text).rlike(HARD)
    fixed = F.create_map(*(x for c, p in HARD_PROBABILITIES.items() for x in (F.lit(c), F.lit(p))))
    likeliest = F.get(names, (F.array_position("_chances", F.array_max("_chances")) - 1).cast("int"))
    out = scored.withColumn("hard", hard).withColumn("predicted", F.when(hard, "high").otherwise(likeliest))
    out = out.withColumn("probabilities", F.when(hard, fixed).otherwise(F.map_from_arrays(names, "_chances")))
    return out.select(*objects.columns, "predicted", "hard", "probabilities")
