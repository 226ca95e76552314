"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civitext.llm.common import fold_of, table
from civitext.llm.compression import fit_compression, score_quality
from civitext.llm.decontamination import contaminated
from civitext.llm.filter_audit import audit_filters
from civitext.llm.licenses import known_digests, scan_licenses
from civitext.llm.mixing import taken_words
from civitext.llm.quality import judge_quality
from civitext.llm.sharding import shard_rows
from civitext.llm.simhash import as_hex, simhash_components
from civitext.llm.token_files import read_token_files, token_folder, write_token_files
from civitext.llm.toxicity import FOLDS, fit_toxicity, score_toxicity
from civitext.llm.urls import judge_urls
from civitext.llm.vector_codes import compress_vectors
from civitext.llm.warc import archived_pages, page_records


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Contaminated documents with the items they contain."""
    found = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "item_id", "n_tokens", "covered", "coverage", F.size("tiles").alias("n_tiles"), F.lit(True).alias("contaminated")
    )


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    trusted = table(spark, sf, "labels").filter("quality = 1")
    judged = judge_quality(table(spark, sf, "documents").select("doc_id", "text"), trusted)
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score",
    )


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return taken_words(table(spark, sf, "documents"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rated = score_toxicity(docs, fit_toxicity(docs, table(spark, sf, "labels")))
    held_out = F.coalesce(fold_of(F.col("row.doc_id"), FOLDS) == 0, F.lit(False))
    return rated.select(F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = token_folder(spark)
    listed = write_token_files(table(spark, sf, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    read = read_token_files(listed, folder, with_ids=False)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    return page_records(archived_pages(table(spark, sf, "pages")))


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(table(spark, sf, "pages"))


def op8_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Known licences in documents, whole or as one of their lines."""
    return scan_licenses(table(spark, sf, "documents"), known_digests(spark)).drop("digest")


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = shard_rows(table(spark, sf, "documents"), F.col("doc_id"))
    return placed.select(
        F.col("row").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash_components(table(spark, sf, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return compress_vectors(table(spark, sf, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op13_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rated = score_quality(docs, fit_compression(docs, table(spark, sf, "labels")))
    held_out = F.coalesce(fold_of(F.col("row.doc_id")) == 0, F.lit(False))
    return rated.select(F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_licenses": op8_licenses,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_classifier": op13_quality_classifier,
}
