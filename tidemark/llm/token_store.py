"""Token ids in binary blocks with Elias-Fano document boundaries.

A store is a table of blocks in ascending document order. A block's payload is self-contained::

    "TMEF"  version u8  id width u8  low bits u8  0  documents u64  ids u64  words u64
    upper bits   `words` u64: boundary i has bit (boundary >> low) + i set
    samples      u64 for every 64th set bit: its place
    lower bits   packed, `low` bits each, to a multiple of 8 bytes
    ids          little-endian, 2 or 4 bytes each, end to end

Boundaries (the ends of documents) take about 2 + log2(ids / documents) bits each; ``select`` finds one from a sample and
a population count, with no table of 64-bit offsets.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept
from tidemark.llm.encode import IdMemo, batches

MAGIC = b"TMEF"
_HEAD = struct.Struct("<4sBBBxQQQ")
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space with access by select."""

    def __init__(self, n: int, low: int, upper: np.ndarray, samples: np.ndarray, lower: np.ndarray):
        self.n, self.low, self.upper, self.samples, self.lower = n, low, upper, samples, lower

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, "u8")
        n = len(values)
        low = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        places = (values >> np.uint64(low)) + np.arange(n, dtype="u8")
        words = (int(places[-1]) // 64 + 1) if n else 0
        bits = np.zeros(words * 64, np.uint8)
        bits[places.astype("i8")] = 1
        upper = np.packbits(bits, bitorder="little").view("<u8")
        rest = ((values[:, None] >> np.arange(low, dtype="u8")) & np.uint64(1)).astype(np.uint8).ravel()
        lower = np.packbits(np.pad(rest, (0, -len(rest) % 64)), bitorder="little")
        return cls(n, low, upper, places[::SAMPLE].astype("<u8"), lower)

    def select(self, i: int) -> int:
        """Value i: from the sample before it, word by word to the set bit, and the lower bits beside."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left, word = i % SAMPLE, place // 64
        bits = int(self.upper[word]) >> (place % 64) << (place % 64)
        while (here := bits.bit_count()) <= left:
            left -= here
            word += 1
            bits = int(self.upper[word])
        for _ in range(left):
            bits &= bits - 1
        high = word * 64 + (bits & -bits).bit_length() - 1 - i
        at = i * self.low
        raw = int.from_bytes(self.lower[at // 8 : (at + self.low + 7) // 8].tobytes(), "little")
        return high << self.low | (raw >> at % 8 & ((1 << self.low) - 1))

    def values(self) -> np.ndarray:
        """All values at once."""
        places = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))
        high = (places - np.arange(self.n)).astype("u8") << np.uint64(self.low)
        rest = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return high | (rest.astype("u8") << np.arange(self.low, dtype="u8")).sum(1, dtype="u8")


def pack_block(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The payload of a block: ids of all its documents and where each document ends."""
    ef = EliasFano.of(ends)
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    head = _HEAD.pack(MAGIC, 1, width, ef.low, ef.n, len(ids), len(ef.upper))
    return b"".join((head, ef.upper.tobytes(), ef.samples.tobytes(), ef.lower.tobytes(), ids.astype(f"<u{width}").tobytes()))


def open_block(payload) -> tuple[np.ndarray, EliasFano]:
    """Ids and document ends of a payload, as views of it."""
    magic, version, width, low, n, total, words = _HEAD.unpack_from(payload)
    if (magic, version) != (MAGIC, 1):
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    parts = []
    for dtype, count in (("<u8", words), ("<u8", -(-n // SAMPLE)), (np.uint8, -(-n * low // 64) * 8), (f"<u{width}", total)):
        parts.append(np.frombuffer(payload, dtype, count, at))
        at += parts[-1].nbytes
    return parts[3], EliasFano(n, low, *parts[:3])


def write_store(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, block_ids: int = 1 << 18) -> DataFrame:
    """Encode every whole text and write all ids, by ascending id_col, to a table of blocks in the shared folder.

    Returns the table: part int, block int, first long (ids before the block in its part), n_ids long, doc_ids
    array<long>, payload binary. A null text counts as empty and holds just end_id (if any); null ids come first; rows
    that share an id stay apart, ordered by text; other columns are ignored. An empty input gives no blocks.
    A block closes at block_ids ids or with the document that passes it, so memory follows the longest document.
    """

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part = IdMemo.of(tokenizer_path), TaskContext.get().partitionId()
        rows, held, n, block, first = [], [], 0, 0, 0

        def close():
            ids = np.concatenate(held)
            payload = pack_block(ids, np.cumsum([len(x) for x in held]))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([n]), pa.array([rows], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["part", "block", "first", "n_ids", "doc_ids", "payload"])

        tail = np.array([] if end_id is None else [end_id], "<u4")
        for b in parts:
            keys = b.column(0).to_pylist()
            for at, texts in batches(b.column(1)):
                ids, starts = memo.encode(texts)
                for i in range(len(texts)):
                    held.append(np.concatenate([ids[starts[i] : starts[i + 1]], tail]))
                    rows.append(keys[at + i])
                    n += len(held[-1])
                    if n >= block_ids:
                        yield close()
                        first, block, rows, held, n = first + n, block + 1, [], [], 0
        if rows:
            yield close()

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = docs.repartitionByRange("id").sortWithinPartitions("id", "text")
    return kept(ordered.mapInArrow(blocks, "part int, block int, first long, n_ids long, doc_ids array<long>, payload binary"))


def read_store(store: DataFrame) -> DataFrame:
    """Documents of a store: doc_id long, start long (ids of all documents before it), n_tokens long, ids binary (uint32).

    Only the totals of the parts, as many as the tasks that wrote them, are summed up in one place and broadcast.
    """
    from pyspark.sql import Window

    totals = store.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(F.col("part"), F.coalesce(before, F.lit(0)).alias("base"))

    def documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for first, keys, payload in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                ids, ef = open_block(payload.as_buffer())
                ends = ef.values().astype("i8")
                starts = np.concatenate([[0], ends[:-1]])
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                offsets = pa.py_buffer((4 * np.concatenate([[0], ends])).astype("<i4").tobytes())
                binary = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, data])
                yield pa.record_batch([keys.values, pa.array(first + starts), pa.array(ends - starts), binary], ["doc_id", "start", "n_tokens", "ids"])

    placed = store.join(F.broadcast(bases), "part").select((F.col("first") + F.col("base")).alias("first"), "doc_ids", "payload")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
