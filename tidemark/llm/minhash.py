"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, id_filter, kept, mix, scratch
from tidemark.llm.components import components
from tidemark.llm.encode import batches

#: Signature slots, in BANDS bands of ROWS. Of pairs at a similarity of 0.8, 3 in a million share no band.
BANDS, ROWS = 24, 4
#: Elements of the sets in one block, and its members, about: a cell's counts of common elements take 50 MB.
BLOCK, MEMBERS = 1 << 16, 2048
_GOLDEN = 0x9E3779B97F4A7C15
_FACTORS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "u8")


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; with fewer words, one of the whole sequence.

    A-Z are lower-cased, and words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], "u8")
    n = min(k, len(h))
    last = len(h) - n + 1
    out = np.full(last, n, "u8")
    for j in range(n):
        out = mix(out + h[j : last + j] * _FACTORS[j % 8] + np.uint64(j))
    return np.unique(out)


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit hashes: m doubles.

    Element x has a random permutation p of the slots and, at step j, a rank of j plus a uniform number for slot p[j];
    a slot keeps its least rank. All elements take step j at once; once every slot holds less than j + 1, no later step
    can lower one, and the rest is skipped.
    """
    slots = np.full(m, np.inf)
    n = len(elements)
    permuted = None
    for j in range(m if n else 0):
        r = mix(elements + np.uint64((j + 1) * _GOLDEN % (1 << 64)))
        to = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype("i8")
        if j == 0:
            at = first = to
        else:
            if permuted is None:
                permuted = np.tile(np.arange(m, dtype="i2" if m < 1 << 15 else "i4"), (n, 1))
                rows = np.arange(n)
                permuted[rows, first] = 0
            at = permuted[rows, to]
            permuted[rows, to] = permuted[:, j]
        np.minimum.at(slots, at, j + (r >> np.uint64(11)).astype("f8") * 2.0**-53)
        if slots.max() < j + 1:
            break
    return slots


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; equal only if the band's number and slots are (but for hash collisions)."""
    bits = np.ascontiguousarray(signature).view("u8").reshape(bands, rows)
    out = mix(np.arange(1, bands + 1, dtype="u8") * np.uint64(_GOLDEN))
    for j in range(rows):
        out = mix(out ^ bits[:, j])
    return out.view("i8")


def _describe(k: int, bands: int, rows: int):
    def describe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sizes, digests, keys = [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), k)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(super_minhash(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return describe


def _full_sets(k: int):
    def full_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at, texts in batches(b.column(1)):
                sets = [shingles(t.as_py(), k).tobytes() for t in texts]
                yield pa.record_batch([b.column(0).slice(at, len(texts)), pa.array(sets, pa.binary())], ["member", "elements"])

    return full_sets


def _linked(percent: int):
    def linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), "u8") for s in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            rows = pa.array(np.flatnonzero(keep))
            yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows)], ["a", "b"])

    return linked


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """member, elements (the full set, made anew from the text) of the documents that ids, one column, names."""
    wanted = kept(ids.toDF("doc_id").distinct())
    docs = kept(docs.where(id_filter(wanted)(F.col("doc_id"))))  # so that few texts are shuffled; and one Python worker to a task
    return kept(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(k), "member long, elements binary"), "none")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are as similar as percent says.

    Many pairs may name the same b: they meet its set as bare ids, in a join that Spark splits, before a's set joins them.
    """
    held = lambda c: sets.select(F.col("member").alias(c), F.col("elements").alias(f"set_{c}"))
    both = pairs.join(held("b"), "b").join(held("a"), "a").select("a", "b", "set_a", "set_b")
    return kept(both.mapInArrow(_linked(percent), "a long, b long"))


def _mixed(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Members of the buckets that hold several components: `minor` outside the largest one; None if there are none.

    Of buckets with the very same members, as bands that one common passage fills have, one stands for all.
    """
    placed = members.join(found.withColumnRenamed("node", "member"), "member", "left").select("key", "member", "n_shingles", F.coalesce("component", "member").alias("component"))
    marks = [F.sum(F.xxhash64("member", F.lit(i)).bitwiseAND((1 << 31) - 1)).alias(f"mark{i}") for i in (1, 2, 3)]
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), *marks)
    marks = [F.sum(f"mark{i}").alias(f"mark{i}") for i in (1, 2, 3)]
    buckets = counts.groupBy("key").agg(F.sum("n").alias("total"), F.sum("size").alias("size"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("kinds"), *marks).where("kinds > 1")
    buckets = buckets.groupBy("mark1", "mark2", "mark3", "total").agg(F.min(F.struct("key", "size", "top")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("b.size") / BLOCK), F.ceil(F.col("total") / MEMBERS))
    buckets = kept(buckets.select("b.key", "total", blocks.alias("blocks"), F.col("b.top.component").alias("largest")))
    if not buckets.limit(1).count():
        return placed, None
    placed = placed.join(buckets, "key").withColumn("minor", F.col("component") != F.col("largest"))
    return kept(placed.withColumn("block", F.pmod(F.xxhash64("member", F.lit(1)), F.col("blocks")))), buckets


def _compared(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of minor members with any of other components in their bucket, block by block.

    A cell (bucket, i, j) holds the minor members of block i and all of block j, about BLOCK elements each; a task counts
    the common elements of all its pairs at once, so sets are sent for members and blocks, never for pairs.
    """
    asking = placed.where("minor").groupBy("key").agg(F.collect_set("block").alias("asking"))
    cells = placed.where("minor").select("key", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), "member", "component", F.lit(True).alias("asks"))
    others = placed.join(kept(asking), "key").select("key", F.explode("asking").alias("i"), F.col("block").alias("j"), "member", "component", F.lit(False).alias("asks"))
    each = sets.withColumn("_set", F.xxhash64("elements")).dropDuplicates(["member", "_set"]).drop("_set")  # an id's texts may differ
    full = cells.unionByName(others).join(each, "member").select("key", "i", "j", "member", "component", "asks", "elements")

    def compare(cell: pa.Table) -> pa.Table:
        asks = np.asarray(cell.column("asks"))
        ids, comps = np.asarray(cell.column("member")), np.asarray(cell.column("component"))
        rows = [np.frombuffer(x.as_buffer(), "u8") for x in cell.column("elements")]
        size = np.array([len(x) for x in rows])
        kinds, where = np.unique(np.concatenate(rows), return_inverse=True)
        of = np.repeat(np.arange(len(rows)), size)
        shared = np.bincount(where[~asks[of]], minlength=len(kinds)) * np.bincount(where[asks[of]], minlength=len(kinds)) > 0
        narrow = np.cumsum(shared) - 1
        of, where = of[shared[where]], narrow[where[shared[where]]]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        place = np.empty(len(rows), "i8")
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        common = np.zeros((len(left), len(right)), "f4")
        order = np.argsort(where, kind="stable")
        of, where = of[order], where[order]
        for first in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(where, [first, first + 2048])
            o, w, mine = of[a:b], where[a:b] - first, asks[of[a:b]]
            x, y = np.zeros((len(left), 2048), "f4"), np.zeros((len(right), 2048), "f4")
            x[place[o[mine]], w[mine]] = 1
            y[place[o[~mine]], w[~mine]] = 1
            common += x @ y.T
        both = common.astype("i8")
        linked = (100 * both >= percent * (size[left][:, None] + size[right] - both)) & (comps[left][:, None] != comps[right])
        p, q = np.nonzero(linked)
        return pa.table([pa.array(ids[left[p]]), pa.array(ids[right[q]])], ["a", "b"])

    return kept(full.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links, itself included), kept (doc_id = component_id).

    Two documents are linked if 100 * |common shingles| >= percent * |all shingles| on their full sets. Documents with
    equal sets, however many, stand as one (the smallest id). In each band's bucket the others are first compared with its
    smallest member alone. Where a bucket then holds several components, members outside the largest are compared with all
    members of other components, in blocks. So no bucket is capped, no table of a group's pairs is made, and every pair
    that shares a band is in one component or was compared.

    An empty table gives no rows. A null, empty or blank text has no shingles and is linked with nothing. Rows with a null id are returned with a null
    component_id and kept. Rows that share an id are one node; each is returned. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    with scratch() as stay:
        named, found = _grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, percent, bands, rows)
        stay += [named, found]
    out = named.join(found.toDF("rep", "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Documents with the representative of their set, and the components of representatives, as tables."""
    described = kept(docs.mapInArrow(_describe(k, bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    alike = kept(described.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep"))
    named = described.join(alike, "digest", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), "bands")
    named = kept(named.withColumn("bands", F.when(F.col("doc_id") == F.col("rep"), F.col("bands"))))
    # ids with several texts link these texts
    links = named.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    members = named.where("bands is not null").select(F.explode("bands").alias("key"), F.col("doc_id").alias("member"), "n_shingles")
    pivots = members.groupBy("key").agg(F.min("member").alias("pivot"), F.min_by("n_shingles", "member").alias("n"), F.max("member").alias("other"))
    pivots = kept(pivots.where("pivot <> other").drop("other"))
    members = kept(members.join(pivots, "key"))
    sets = _sets(docs, members.select("member"), k)
    near = 100 * F.least("n_shingles", "n") >= percent * F.greatest("n_shingles", "n")
    star = kept(members.where("member <> pivot").where(near).select(F.col("member").alias("a"), F.col("pivot").alias("b")).distinct())
    links = links.unionByName(_verified(star, sets, percent))
    members, found = members.where("member <> pivot").select("key", "member", "n_shingles"), components(links)
    placed, buckets = _mixed(members, found)
    if buckets is not None:
        links = links.unionByName(_compared(placed, sets, percent))
        found = components(links)
    return named, found
