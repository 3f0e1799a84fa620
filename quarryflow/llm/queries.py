"""The registered query of each corpus operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.llm import alignment, archives, codebooks, fingerprints, licenses, lines, minhash, mixing, neighbours, packing, quality, secrets, substrings
from quarryflow.llm.common import read_table


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.group_documents(read_table(spark, sf_dir, "documents"), k=2, percent=80, stored=True)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"), stored=True)
    return plan.select("doc_id", "size", "source_size", "target", mixing.words_taken().alias("taken"), "draws")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(read_table(spark, sf_dir, "documents"), stored=True)
    return kept.select("doc.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), word_bpe_path())


def op9_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeated_passages(read_table(spark, sf_dir, "documents"), stored=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_tokenizers(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codebooks.compress(read_table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archives.scratch_folder(spark)
    archives.write_archives(read_table(spark, sf_dir, "pages"), folder, stored=True)
    return archives.read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_secret_scan": op3_secret_scan,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_mix_sources": op5_mix_sources,
        "op6_line_dedup": op6_line_dedup,
        "op7_edit_fingerprints": op7_edit_fingerprints,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_adaptive_scan_ann": op9_adaptive_scan_ann,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
        "op12_vector_codes": op12_vector_codes,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle_sql(), "op3_secret_scan": secrets.oracle_sql(), "op10_substring_dedup": substrings.oracle_sql()}
