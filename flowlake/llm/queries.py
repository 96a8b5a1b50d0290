"""The registered queries of the corpus operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import decontaminate, fingerprint_index, licenses, ngram_join, oracle, pieces, quality_rules, resampling, suffix_dedup, token_files, toxicity
from flowlake.llm.common import scratch, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op3_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return resampling.resample(table(spark, sf_dir, "documents"), good)


def op4_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_index.incremental_dedup(table(spark, sf_dir, "documents"), scratch(spark, "fingerprint-index"), batches=2, length=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=5, percent=80)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "token-files")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), root, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.digests(token_files.read_token_files(spark, root, manifest))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", names).alias("licenses"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_pieces": op2_pieces,
    "op3_resampling": op3_resampling,
    "op4_fingerprint_index": op4_fingerprint_index,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_token_files": op7_token_files,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
