"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Nearness by Euclidean distance is a maximum inner product: |q - x| is least where q.x - |x|^2 / 2 is largest. Codes
approximate q.x; |x|^2 / 2 is kept as it is. A code's vector c and its error |x - c| bound what a scan may leave out:
|q - x| >= |q - c| - |x - c|.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import kept
from tidemark.llm.vector_dedup import by_length, valid_rows

CENTRES = 16


@dataclass
class Codebook:
    """Sixteen centres for each pair of dimensions; eta: the weight of residuals parallel to a vector."""

    centres: np.ndarray  # subspaces, 16, 2
    eta: float

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2))).reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the anisotropic loss, from the nearest centres."""
        parts = self._parts(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        codes = np.empty(parts.shape[:2], "u1")
        gap = np.empty_like(parts)
        for m, c in enumerate(self.centres):
            codes[:, m] = ((parts[:, m, None] - c) ** 2).sum(2).argmin(1)
            gap[:, m] = parts[:, m] - c[codes[:, m]]
        along = (gap * unit).sum((1, 2))
        for _ in range(sweeps):
            for m, c in enumerate(self.centres):
                new = parts[:, m, None] - c
                turned = (along - (gap[:, m] * unit[:, m]).sum(1))[:, None] + (new * unit[:, m, None]).sum(2)
                codes[:, m] = ((new**2).sum(2) + (self.eta - 1) * turned**2).argmin(1)
                gap[:, m] = new[np.arange(len(x)), codes[:, m]]
                along = turned[np.arange(len(x)), codes[:, m]]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, with a last dimension more where theirs are odd."""
        return self.centres[np.arange(len(self.centres)), codes].reshape(len(codes), -1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with all centres, two subspaces to a table: (bytes, queries, 256)."""
        parts = self._parts(q)
        one = np.einsum("qmd,mcd->mqc", parts, self.centres)
        if len(one) % 2:
            one = np.concatenate([one, np.zeros_like(one[:1])])
        return (one[1::2, :, :, None] + one[0::2, :, None, :]).reshape(len(one) // 2, len(q), 256).astype("f4")


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, 0::2] | codes[:, 1::2] << 4


def fit_codebook(x: np.ndarray, threshold: float = 0.2, rounds: int = 4, seed: int = 3) -> Codebook:
    """Centres that minimise the anisotropic loss on a sample of vectors; encoding and least squares in turn."""
    n, d = x.shape
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    parts = Codebook(np.empty(0), eta)._parts(x)
    subspaces = parts.shape[1]
    centres = np.empty((subspaces, CENTRES, 2))
    for m in range(subspaces):
        c = parts[rng.choice(n, CENTRES, replace=n < CENTRES), m] + rng.normal(size=(CENTRES, 2)) * 1e-9
        for _ in range(12):
            code = ((parts[:, m, None] - c) ** 2).sum(2).argmin(1)
            size = np.bincount(code, minlength=CENTRES)
            for k in range(2):
                c[:, k] = np.where(size > 0, np.bincount(code, parts[:, m, k], CENTRES) / np.maximum(size, 1), c[:, k])
        centres[m] = c
    book = Codebook(centres, eta)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    wide = subspaces * CENTRES * 2
    for _ in range(rounds):
        codes = book.encode(x).astype("i8")
        # residual = parts - centres[codes]; its loss is quadratic in all centres at once
        left, right = np.zeros((wide, wide)), np.zeros(wide)
        at = ((np.arange(subspaces) * CENTRES + codes)[:, :, None] * 2 + np.arange(2)).reshape(n, -1)
        u, p = unit.reshape(n, -1), parts.reshape(n, -1)
        np.add.at(right, at, p + (eta - 1) * (p * u).sum(1, keepdims=True) * u)
        left[np.arange(wide), np.arange(wide)] = np.bincount(at.ravel(), minlength=wide)
        for some in np.array_split(np.arange(n), max(1, n // 512)):
            mark = np.zeros((len(some), wide))
            np.put_along_axis(mark, at[some], u[some], 1)
            left += (eta - 1) * mark.T @ mark
        left[np.arange(wide), np.arange(wide)] += 1e-6
        book.centres = np.linalg.solve(left, right + 1e-6 * book.centres.reshape(-1)).reshape(subspaces, CENTRES, 2)
    return book


def build_index(vectors: DataFrame, sample: int = 4096, threshold: float = 0.2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict[int, Codebook]]:
    """The index, a table of vec_id, half_norm, codes (four bits for two dimensions), code_norm (the squared length of what
    the codes stand for), gap (its distance from the embedding) and embedding, and its codebooks.

    Codebooks are fitted on at most about `sample` valid vectors of all rows, drawn by a hash of their ids; every valid
    row is indexed. Null, zero and non-finite vectors and null ids are left out. Each vector length has a codebook.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null")
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)))) if n > sample else rows
    books: dict[int, Codebook] = {}
    column = pa.array([r[0] for r in drawn.select("embedding").collect()], pa.list_(pa.float64()))
    for some, x in by_length(column, np.flatnonzero(valid_rows(column))):
        books[x.shape[1]] = fit_codebook(x, threshold)

    def encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for some, x in by_length(b.column(1), np.flatnonzero(valid_rows(b.column(1)))):
                book = books.get(x.shape[1])
                codes, made = np.zeros((len(x), 0), "u1"), np.zeros_like(x)
                if book:
                    codes = book.encode(x)
                    codes, made = pack_codes(codes), book.decode(codes)
                gap = np.sqrt(((np.pad(x, ((0, 0), (0, made.shape[1] - x.shape[1]))) - made) ** 2).sum(1))
                rows = pa.array(some)
                yield pa.record_batch([b.column(0).take(rows), pa.array((x * x).sum(1) / 2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((made * made).sum(1)), pa.array(gap), b.column(1).take(rows)], ["vec_id", "half_norm", "codes", "code_norm", "gap", "embedding"])

    return kept(rows.mapInArrow(encoded, "vec_id long, half_norm double, codes binary, code_norm double, gap double, embedding array<double>")), books


def _scan(ids: np.ndarray, q: np.ndarray, k: int, rerank: int, book: Codebook | None):
    """A task's k nearest rows of each query, over its batches."""
    dim = q.shape[1]

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = book.tables(q) if book else None  # made by each task: they take thirty times the queries' room
        if tables is not None:
            lengths = (q * q).sum(1)
            # what summing single-precision products may add to or take from a squared distance, at most
            slack = 4 * (len(tables) + 2) * 2.0**-24 * np.abs(tables.astype("f8")).max(2).sum(0)
        best, names = [np.empty(0) for _ in ids], [np.empty(0, "i8") for _ in ids]
        for b in parts:
            rows = np.flatnonzero(np.asarray(b.column("embedding").value_lengths()) == dim)
            if not len(rows):
                continue
            b = b.take(pa.array(rows))
            vec, x = np.asarray(b.column("vec_id")), np.asarray(b.column("embedding").flatten(), "f8").reshape(-1, dim)
            products = None
            if tables is not None and rerank < len(vec):
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), "u1").reshape(len(vec), -1)
                half, code_norm, gap = (np.asarray(b.column(c), "f8") for c in ("half_norm", "code_norm", "gap"))
                products = np.zeros((len(ids), len(vec)), "f4")
                for t, table in enumerate(tables):
                    products += table[:, codes[:, t]]

            def compare(i: int, near: np.ndarray) -> None:
                near = near[vec[near] != ids[i]]
                far = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                all_ids, all_far = np.concatenate([names[i], vec[near]]), np.concatenate([best[i], far])
                top = np.lexsort((all_ids, all_far))[:k]
                names[i], best[i] = all_ids[top], all_far[top]

            for i in range(len(ids)):
                if products is None:
                    compare(i, np.arange(len(vec)))
                    continue
                least = lengths[i] + code_norm
                least = least * (1 - 1e-12) - 2.0 * products[i] - slack[i]

                def open_rows(i: int = i, least: np.ndarray = least) -> np.ndarray:
                    """Rows that may be as near as the k-th so far."""
                    return ~(least > (best[i][-1] + gap) ** 2) if len(best[i]) == k else np.ones(len(vec), bool)

                # the best by score first, which closes most others; then all that are still open
                near = np.flatnonzero(open_rows())
                if len(near) > rerank:
                    near = near[np.argpartition(half[near] - products[i, near], rerank)[:rerank]]
                compare(i, near)
                left = open_rows()
                left[near] = False
                if left.any():
                    compare(i, np.flatnonzero(left))
        sizes = [len(x) for x in names]
        yield pa.record_batch([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate(names)), pa.array(np.concatenate(best))], ["query_id", "vec_id", "score"])

    return scan


def search(index: DataFrame, books: dict[int, Codebook], queries: DataFrame, k: int = 10, rerank: int = 400, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows but its own id, nearest first, ties to smaller ids.

    queries: vec_id and embedding of the index. Blocks of about `block` queries go to all tasks one after the other, so the
    driver and a task hold one block at a time, and each block's answers are a table in the shared folder. A task scans its
    rows' codes; of each Arrow batch the best `rerank` (all, if it has fewer) are compared exactly, and then every row that
    the bound of its code's error leaves open, however many: results are exact. A task returns k rows for a query. Rows
    sharing a query's id are not its neighbours; queries given twice are answered once, and of different vectors that share
    a query's id one is taken. No queries give no rows.
    """
    queries = queries.select("vec_id", "embedding").dropDuplicates(["vec_id"])
    n = queries.count()
    blocks = -(-n // block)
    spark, parts = queries.sparkSession, []
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()
        vectors = pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))
        for some, q in by_length(vectors, np.arange(len(rows))):
            ids = np.array([rows[j]["vec_id"] for j in some], "i8")
            near = index.mapInArrow(_scan(ids, q, k, rerank, books.get(q.shape[1])), "query_id long, vec_id long, score double")
            parts.append(kept(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.unionByName, parts)
