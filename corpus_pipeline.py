"""Corpus pipeline: quality classifier, near-duplicate removal, pseudonyms, packing; each stage is written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import kept, without
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.pii import pseudonymise
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import pseudonym_key, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the table labels, doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return without(docs, kept(near_duplicates(docs).where("not kept").select("doc_id").distinct()), "doc_id")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data in their texts; n_chars follows."""
    out = pseudonymise(docs, pseudonym_key(spark))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids, with their ids."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("PII", pii), ("packing", packing)]

#: Signatures, fitted models and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in turn, each reading what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
