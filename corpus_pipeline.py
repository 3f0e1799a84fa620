"""A corpus pipeline of five operators: quality, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Between stages run() writes
Parquet to the shared scratch folder and reads it back, so the stages' docs are files read as they are.

The mix repeats documents of sources that weigh more than they hold, so doc_ids recur from there on; a document that
the mix takes in part ends after its last word taken. The last stage returns packed pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryflow.llm import lines, minhash, mixing, packing, quality
from quarryflow.llm.common import discard, keep, read_table
from quarryflow.llm.queries import word_bpe_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the table beside them."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another line, equal or similar, already stands for."""
    return lines.drop_repeated_lines(docs, stored=True)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles."""
    return minhash.drop_near_duplicates(docs, stored=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each draw of the mix as one document, with the columns of documents, in the mix's shards and their order."""
    return mixing.in_shards(mixing.drawn_documents(docs, stored=True)).select("doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids and their places in the packed sequences."""
    return packing.pack_documents(docs, word_bpe_path(), ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: The stages learn, hash and search; no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage read goes when its result is kept."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.split(" ")[0].lower())
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
