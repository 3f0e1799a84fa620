"""Each stage of the pipeline on what the stage before kept, against brute force."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quarryflow.llm import quality
from quarryflow.llm.common import keep
from test_documents import brute_groups, brute_pieces


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        kept[name] = docs.collect()
    first, second, third, fourth = (kept[name] for name, _ in corpus_pipeline.STAGES[:-1])

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert sum(r["doc_id"] in {x["doc_id"] for x in first} for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if labels.get(r["doc_id"]) == 1) >= 0.95 * sum(labels.values())
    before, after = {r["doc_id"]: r["text"] for r in first}, {r["doc_id"]: r["text"] for r in second}
    assert before.keys() == after.keys() and all(r["n_chars"] == len(r["text"]) for r in second)
    shown = Counter(line for t in after.values() for line in t.split("\n") if line.strip())
    assert max(shown.values()) == 1 and {line for t in after.values() for line in t.split("\n")} <= {line for t in before.values() for line in t.split("\n")} | {""}
    groups, _ = brute_groups(after.items(), 5, 80)
    assert sorted(r["doc_id"] for r in third) == sorted(set(groups.values()))
    drawn = sum(len(r["text"].split()) for r in fourth)
    assert abs(drawn - sum(len((r["text"] or "").split()) for r in third)) <= 20
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == brute_pieces([(r["doc_id"], r["text"]) for r in fourth])


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert quality.SAMPLE_ROWS <= 20_000


def test_stages_on_odd_columns(spark, odd_docs):
    """Columns named as the operators' own end no stage."""
    docs = odd_docs.withColumn("target", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, keep(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() >= docs.count()
