"""What the operators of this subpackage share: tables in the shared folder, filters of ids and small numeric helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.shared import kept, release, scratch, shared_folder, shared_root

__all__ = ["bounded_batches", "id_filter", "kept", "mix", "release", "scratch", "shared_folder", "shared_root", "without"]

#: The setting that bounds an Arrow batch on its way to a Python worker, and the bytes of one.
BATCH_SETTING, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on, batches of rows end at ARROW_BYTES, unless the session has a bound of its own.

    Spark's default ends them at 10,000 rows, which of long texts or sets takes hundreds of MB outside the heap.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(ARROW_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of a filter for each id, and at most (32 MB); bits set for an id.
FILTER_BITS, FILTER_MOST, FILTER_MARKS = 12, 1 << 28, 4


def _marks(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for j in range(1, FILTER_MARKS + 1):
        yield mix(h.view("u8") + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(size - 1)


def id_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """A condition that holds for all ids (one column of longs) and for about one in a hundred others: a Bloom filter.

    It spares rows a shuffle; what it lets through has yet to be joined. Its size, which the driver and the executors
    hold, follows the number of ids up to FILTER_MOST bits; with more ids it lets more others through and nothing else
    changes. Segments of the filter are made in tasks of their own, so that no task holds or sends it whole.
    """
    spark, n = ids.sparkSession, ids.count()
    size = min(FILTER_MOST, 1 << max(10, (FILTER_BITS * n - 1).bit_length()))
    segments = 64 if size > 1 << 20 else 1
    each = size // segments

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in parts:
            h = np.asarray(b.column(0), "i8")
            for s in np.unique(h % segments).tolist():
                bits = made.setdefault(s, np.zeros(each, bool))
                for at in _marks(h[h % segments == s], each):
                    bits[at] = True
        for s, bits in made.items():
            yield pa.record_batch([pa.array([s]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    hashed = ids.toDF("id").select(F.xxhash64("id").alias("h"))
    whole = np.zeros((segments, each // 8), np.uint8)
    for r in hashed.repartition(segments, F.pmod("h", F.lit(segments))).mapInArrow(build, "segment long, bits binary").toLocalIterator():
        whole[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(whole)

    @F.arrow_udf("boolean")
    def maybe(hashes: pa.Array) -> pa.Array:
        h = np.array(hashes, "i8")
        held = sent.value
        segment = h % segments
        out = np.ones(len(h), bool)
        for at in _marks(h, each):
            out &= (held[segment, (at >> np.uint64(3)).astype("i8")] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return pa.array(out)

    return lambda column: maybe(F.xxhash64(column.cast("long")))


def without(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows whose `on` is not among ids (one column of longs). Only rows that the ids' filter lets through are shuffled."""
    maybe = id_filter(ids)(F.col(on))
    return rows.where(~maybe).union(rows.where(maybe).join(ids.toDF(on), on, "left_anti").select(rows.columns))
