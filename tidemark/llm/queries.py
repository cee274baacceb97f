"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 1024 ids."""
    from tidemark.llm.packing import pack

    made = pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels of two thirds."""
    from tidemark.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles are linked at a similarity of 0.8 or more."""
    from tidemark.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by way of a cache in the shared folder, which begins empty so that all is measured."""
    from tidemark.llm.common import shared_folder
    from tidemark.llm.token_counts import count_tokens

    made = count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), shared_folder(spark, "token-cache"))
    return made.withColumn("over_limit", F.col("n_tokens") > 2048)


#: The setting that holds a deployment's secret key, and what stands in for it in tests and checks.
KEY_SETTING, PSEUDONYM_KEY = "spark.tidemark.pseudonymKey", "change-this-key"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, PSEUDONYM_KEY)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts with personal data replaced by pseudonyms, and how many were."""
    from tidemark.llm.pii import pseudonymise

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, pseudonym_key(spark), count_col="n_replaced")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of all documents."""
    from tidemark.llm.licenses import scan_licences

    made = scan_licences(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.size("sentences").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of all documents."""
    from tidemark.llm.pieces import n_best_segments

    made = n_best_segments(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return made.select("doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, read back from the blocks that hold them."""
    from tidemark.llm.token_store import read_store, write_store

    made = read_store(write_store(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))
    return made.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors of equal label at a cosine of 0.98 or more."""
    from tidemark.llm.vector_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each whose id is divisible by 100, of all."""
    from tidemark.llm.ann import build_index, search

    index, books = build_index(_table(spark, sf_dir, "embeddings"))
    return search(index, books, index.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_quality, op3_minhash, op4_token_counts, op5_pii, op6_licences, op7_pieces, op8_token_store, op9_vector_dedup, op10_ann)}
SQL: dict[str, str] = {}
