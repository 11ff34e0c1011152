"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, BPE. Counted as part of the corpus subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquarry.llm import bpe, line_dedup, minhash, mixing, quality_rules
from reelquarry.llm.shared import folders, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a document's characters in repeated passages from which it is a copy, for near-dedup, and no document with a passage.
COPIES_FROM = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy; its toxic words are learned from the labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return quality_rules.filter_documents(docs, vocabulary=quality_rules.toxic_words(docs, labels))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; n_chars follows the text. Whole copies stay as they are for the next stage."""
    out = line_dedup.dedup_lines(docs, copies_from=COPIES_FROM)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the mixed documents, with the digests of op5's contract."""
    encoded = bpe.encode(docs.select("doc_id", "text", "source"), bpe.default_tokenizer())
    return encoded.select(
        "doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


STAGES = [("quality_rules", quality_stage), ("line_dedup", lines_stage), ("minhash_near_dedup", near_stage), ("mix_sources", mix_stage), ("bpe", bpe_stage)]

#: SQL can't express the last stage; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and what it was made of is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    mark = folders()
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
