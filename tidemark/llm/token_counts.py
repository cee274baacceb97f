"""Token counts from a digest cache: stored counts by content and tokenizer version, new texts encoded once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_filter, kept, scratch
from tidemark.llm.encode import batches, counter, folds_text

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def version(tokenizer_path: str) -> str:
    """Digest of a tokenizer's file and of the library that reads it."""
    import tokenizers

    return hashlib.sha256(Path(tokenizer_path).read_bytes() + tokenizers.__version__.encode()).hexdigest()[:32]


def content_digest(text: Column, folds: bool) -> Column:
    """The digest of a text's normal form: if the tokenizer folds them, A-Z in lower case and single blanks.

    Only texts of ASCII characters are folded (others' normal forms depend on their neighbours), and none with "<|", which
    special tokens begin with: so texts of one digest always have one count.
    """
    plain = F.lower(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))
    normal = F.when(~text.rlike(r"[^\x00-\x7f]|<\|"), plain).otherwise(text) if folds else text
    return F.unhex(F.sha2(F.encode(normal, "UTF-8"), 256))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes long (UTF-8) and n_tokens long of every whole text; a null text counts as empty.

    The digest of a text's normal form and the tokenizer's version find its count in the Parquet table at cache_path
    (missing or None: empty). Texts not found there are encoded once for each digest and appended to the table. Texts whose
    digest occurs once and is not stored are encoded where they are read; only the texts of the others' ids are shuffled,
    to the one that stands for a digest. Repeated rows give rows each; rows with a null id count like others; an empty
    table gives no rows; other columns are ignored.
    """
    spark, of, folds = docs.sparkSession, version(tokenizer_path), folds_text(tokenizer_path)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cache = spark.createDataFrame([], CACHE_SCHEMA)
    if cache_path is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    cache = cache.where(F.col("version") == of).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in parts:
            names = b.schema.names[:-1]
            for at, texts in batches(b.column(b.num_columns - 1)):
                yield pa.record_batch([*(b.column(n).slice(at, len(texts)) for n in names), pa.array(count(texts))], [*names, "n_tokens"])

    with scratch() as stay:
        keys = kept(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text"), folds).alias("digest")))
        several = keys.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        shared = kept(several.union(cache.select("digest")).distinct())
        maybe = id_filter(kept(keys.join(shared, "digest", "left_semi").select("doc_id").distinct()))
        # an id that the filter doesn't name has only rows whose digests are theirs alone and new
        alone = docs.where(~maybe(F.col("doc_id"))).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text"), folds).alias("digest"), "text")
        alone = kept(alone.mapInArrow(counts, "doc_id long, n_bytes long, digest binary, n_tokens long"))
        others = kept(keys.where(maybe(F.col("doc_id"))))
        owners = others.groupBy("digest").agg(F.min("doc_id").alias("owner")).join(cache, "digest", "left_anti")
        texts = docs.where(maybe(F.col("doc_id"))).withColumn("own", content_digest(F.col("text"), folds))
        # a digest's owner is one of few rows of its id, so neither side is skewed
        to_encode = texts.join(owners, F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("own") == F.col("digest"))).select("digest", "text")
        found = kept(to_encode.mapInArrow(counts, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
        if cache_path is not None:
            found.union(alone.select("digest", "n_tokens")).select(F.lit(of).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
            found = kept(found.unionByName(cache.join(others.select("digest").distinct(), "digest", "left_semi")))
        stay += [alone, others, found]
    return alone.select("doc_id", "n_bytes", "n_tokens").unionByName(others.join(found, "digest").select("doc_id", "n_bytes", "n_tokens"))
