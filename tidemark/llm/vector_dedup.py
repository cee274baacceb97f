"""Near-duplicate vectors: projections decoded to E8 lattice points, neighbouring cells probed, cosines verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept, mix, scratch
from tidemark.llm.components import components

#: Tables, cells probed in each, and the length of a projected unit difference's coordinates. A pair at a cosine of 0.98
#: meets in a table in 71 of 100 cases, so fewer than one in a million is missed (tests measure it). Unrelated vectors meet
#: in a table once in about 30,000 cases; with far more vectors of one label, raise the scale and the tables: at 1.5, where
#: they meet once in about a million, 30 tables miss as few.
TABLES, PROBES, SCALE = 12, 3, 1.0
_PAIRS = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
#: The lattice's 240 shortest vectors and 0: where the neighbouring cells are.
NEIGHBOURS = np.array([np.zeros(8), *_PAIRS, *(np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0)])


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points whose coordinates have an even sum."""
    out = np.rint(x)
    odd = np.flatnonzero(out.sum(1) % 2)
    gap = x[odd] - out[odd]
    at = np.abs(gap).argmax(1)
    out[odd, at] += np.where(gap[np.arange(len(odd)), at] < 0, -1, 1)
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (even integer points and those shifted by a half) to each row."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def _keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    out = salt
    for j in range(8):
        out = mix(out ^ (2 * points[..., j]).astype("i8").view("u8") ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return out.view("i8")


def cells(unit: np.ndarray, salt: np.ndarray, tables: int, probes: int, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's cell in every table, and those it probes: the nearest `probes` cells but its own."""
    own, asked = [], []
    dim = unit.shape[1]
    for t in range(tables):
        x = unit @ np.random.default_rng((t, dim)).normal(size=(dim, 8)) * scale
        point = decode(x)
        mark = mix(salt ^ np.uint64(t * 1009 + dim))
        own.append(_keys(point, mark))
        far = ((x - point)[:, None] - NEIGHBOURS) ** 2
        near = 1 + np.argpartition(far.sum(2)[:, 1:], probes - 2, axis=1)[:, : probes - 1]  # its own is the nearest
        asked.append(_keys(point[:, None] + NEIGHBOURS[near], np.repeat(mark[:, None], probes - 1, 1)))
    return np.stack(own, 1), np.concatenate(asked, 1)


def valid_rows(vectors: pa.Array, least: int = 1) -> np.ndarray:
    """Rows that are not null, not zero, and have finite components only."""
    out = np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v.is_valid and v.values.null_count == 0 and len(v.values) >= least:
            x = np.asarray(v.values, "f8")
            out[i] = np.isfinite(x).all() and bool(x.any())
    return out


def by_length(vectors: pa.Array, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length and their vectors in double precision."""
    length = np.asarray(vectors.value_lengths().fill_null(0))
    for n in np.unique(length[rows]):
        some = rows[length[rows] == n]
        yield some, np.asarray(vectors.take(pa.array(some)).flatten(), "f8").reshape(-1, n)


def _describe(tables: int, probes: int, scale: float):
    def describe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, len(batch), 1000):
                b = batch.slice(at, 1000)
                ids, vectors, labels = b.columns
                digests, own, asked = ([None] * len(b) for _ in range(3))
                fit = valid_rows(vectors) & np.asarray(labels.is_valid()) & np.asarray(ids.is_valid())
                label = np.asarray(labels.fill_null(0), "i8")
                for rows, x in by_length(vectors, np.flatnonzero(fit)):
                    unit = x / np.abs(x).max(1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    mine, theirs = cells(unit, mix(label[rows].view("u8")), tables, probes, scale)
                    for i, r in enumerate(rows):
                        digests[r] = hashlib.blake2b(label[r].tobytes() + (x[i] + 0.0).tobytes(), digest_size=16).digest()
                        own[r], asked[r] = mine[i], theirs[i]
                lists = pa.list_(pa.int64())
                yield pa.record_batch([ids, pa.array(digests, pa.binary()), pa.array(own, lists), pa.array(asked, lists), pc.if_else(pa.array(fit), vectors, None)], ["vec_id", "digest", "own", "asked", "embedding"])

    return describe


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows; components are scaled first, so that no square overflows or vanishes."""
    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def _linked(least: float):
    def linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x, y = b.column("vector_a"), b.column("vector_b")
            keep = np.zeros(len(b), bool)
            alike = np.flatnonzero(np.asarray(x.value_lengths()) == np.asarray(y.value_lengths()))
            for rows, some in by_length(x, alike):
                keep[rows] = cosine(some, np.asarray(y.take(pa.array(rows)).flatten(), "f8").reshape(some.shape)) >= least
            rows = pa.array(np.flatnonzero(keep))
            yield b.select(["a", "b", "rep_a", "rep_b"]).take(rows)

    return linked


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable), kept (vec_id = component_id) of every row.

    Rows of equal label are linked if the cosine of their vectors is at least `least`. Rows with equal label and vector,
    however many, stand as one class, whose size is added to the links of each. A pair of classes is found if in some table
    they share a cell or one lies in a cell that the other probes, and is then verified in double precision. Null, zero or
    non-finite vectors, null labels and null ids link with nothing (a null id's component is null, and it is kept); vectors
    of different lengths don't link. Rows that share an id are one node of the components, whatever their vectors, and each
    counts the other rows it is linked with. An empty table gives no rows. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    with scratch() as stay:
        described = kept(rows.mapInArrow(_describe(tables, probes, scale), "vec_id long, digest binary, own array<long>, asked array<long>, embedding array<double>"))
        classes = described.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), *(F.first(c).alias(c) for c in ("own", "asked", "embedding")))
        classes = kept(classes.withColumn("cls", F.monotonically_increasing_id()))
        named = kept(described.select("vec_id", "digest").join(classes.select("digest", "cls", "rep", "size"), "digest", "left").drop("digest"))
        stay.append(named)
        mine = classes.select(F.explode("own").alias("key"), F.col("cls").alias("x"))
        others = classes.select(F.explode("asked").alias("key"), F.col("cls").alias("y"), F.lit(False).alias("same"))
        theirs = mine.select("key", F.col("x").alias("y"), F.lit(True).alias("same")).union(others)
        met = mine.join(theirs, "key").where("x < y or not same and x <> y")
        pairs = kept(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        held = lambda c: classes.select(F.col("cls").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("embedding").alias(f"vector_{c}"))
        both = pairs.join(held("a"), "a").join(held("b"), "b").select("a", "b", "rep_a", "rep_b", "vector_a", "vector_b")
        links = kept(both.mapInArrow(_linked(least), "a long, b long, rep_a long, rep_b long"))
        sizes = classes.select(F.col("cls").alias("b"), "size")
        each = links.select("a", "b").union(links.select("b", "a"))
        more = kept(each.join(sizes, "b").groupBy("a").agg(F.sum("size").alias("more")))
        stay.append(more)
        found = components(links.select("rep_a", "rep_b").union(named.where("rep <> vec_id").select("vec_id", "rep")))
        stay.append(found)
    out = named.join(more.withColumnRenamed("a", "cls"), "cls", "left").join(found.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    n_links = F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("more", F.lit(0))
    out = out.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
