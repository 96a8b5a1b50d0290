"""A corpus pipeline over `documents`, from toxicity to token ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir), where docs has the
columns doc_id, text, lang, source and n_chars, and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All stages but the last return the
columns of documents.

toxicity            documents that the grammar scores 0.5 or more go; the model is fitted on
                    labelled rows among docs that aren't held out
ngram_join          of each group of near copies the document with the smallest doc_id stays, and
                    of rows that share it the smallest by text, lang, source and n_chars;
                    rows without doc_id stay
suffix_dedup        strings of 100 bytes that also start earlier are cut out of the texts, but
                    for parts of characters; n_chars counts what is left
decontamination     documents that hold a window of a benchmark item go
pieces              encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import ship
from flowlake.llm import decontaminate, ngram_join, pieces, suffix_dedup, toxicity
from flowlake.llm.common import SCRATCH, drop_path, drop_scratch, scratch, table, written
from flowlake.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[2:]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS[1:]).where("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    stay = ngram_join.ngram_join(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    named = docs.select(*COLUMNS).join(written(stay, "pipeline-stay"), "doc_id")
    several = named.where("_rows > 1").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_least"))
    return named.where("_rows = 1").select(*COLUMNS).unionByName(several.select("doc_id", "_least.*")).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = suffix_dedup.suffix_dedup(docs, length=100, characters=True, carry=("lang", "source"))
    return found.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, carry=REST)
    return found.where("n_hit = 0").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.digests(pieces.encode(docs, tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", not_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", not_contaminated),
    ("pieces", encoded),
]

#: Neither the grammar's scores nor the library's ids can be written in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What the stages wrote is deleted as soon as the next one has read it; the last table stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since, path = len(SCRATCH), scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_scratch(spark, since, keep=(path,))
        if last:
            drop_path(spark, last)
        last = path
    return docs
