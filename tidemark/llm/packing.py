"""Cost-balanced packing of documents into sequences of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encode import IdMemo, batches

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold each document's ids once, in as few sequences as fit.

    A document's attention costs linear * n + quadratic * n * n. Whole multiples of the capacity are sequences of their
    own. What remains of each document, in descending order of cost, goes to the cheapest sequence with room for it; where
    none has, the cheapest sequences with any room take it in parts. Less than one sequence's room is left over in all.
    """
    out, rests, sequence = [], [], 0
    for d, n in enumerate(lengths.tolist()):
        whole = n // capacity
        out += [(d, k * capacity, capacity, sequence + k, 0) for k in range(whole)]
        sequence += whole
        if n % capacity:
            rests.append((n % capacity, d, whole * capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    open_ = -(-sum(r[0] for r in rests) // capacity)
    used, cost = np.zeros(open_, "i8"), np.zeros(open_)
    for n, d, start in rests:
        while n:
            room = capacity - used
            s = int(np.argmin(np.where(room >= n, cost, np.inf)))
            if room[s] < n:
                s = int(np.argmin(np.where(room > 0, cost, np.inf)))
            take = min(n, int(room[s]))
            out.append((d, start, take, sequence + s, int(used[s])))
            used[s] += take
            cost[s] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 2048, block_ids: int = 1 << 22, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """Sequences of at most `capacity` ids made of all documents, each followed by end_id.

    Returns a row for each piece: doc_id, start (its document's ids before it), length, doc_tokens (with end_id),
    sequence_id, offset (in the sequence, gapless from 0) and ids (little-endian uint32). Each task packs the documents
    that it reads in blocks of at most block_docs documents or about block_ids ids, so nothing is shuffled and memory
    doesn't grow with the input; less than one sequence of a block is padding. Sequence ids hold the task's number, which
    is the same when a task is run again. Null texts count as empty and are packed as end_id alone; null ids, repeated
    rows and repeated ids are kept as they come; other columns are ignored; an empty input gives no rows.
    """

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, next_id = IdMemo.of(tokenizer_path), TaskContext.get().partitionId() << 32
        held, keys, n = [], [], 0

        def close():
            lengths = np.array([len(x) for x in held])
            made = assign(lengths, capacity, linear, quadratic)
            cols = np.array(made, "i8").T
            d = cols[0]
            doc_ids = pa.array(keys, pa.int64()).take(pa.array(d))
            ids = pa.array([held[i][s : s + m].tobytes() for i, s, m, _, _ in made], pa.binary())
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.record_batch([doc_ids, pa.array(cols[1]), pa.array(cols[2]), pa.array(lengths[d]), pa.array(next_id + cols[3]), pa.array(cols[4]), ids], names), int(cols[3].max()) + 1

        end = np.array([end_id], "<u4")
        for b in parts:
            names = b.column(0).to_pylist()
            for at, texts in batches(b.column(1)):
                ids, starts = memo.encode(texts)
                for i in range(len(texts)):
                    held.append(np.concatenate([ids[starts[i] : starts[i + 1]], end]))
                    keys.append(names[at + i])
                    n += len(held[-1])
                    if len(held) >= block_docs or n >= block_ids:
                        batch, made = close()
                        yield batch
                        held, keys, n, next_id = [], [], 0, next_id + made
        if held:
            yield close()[0]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, SCHEMA)
