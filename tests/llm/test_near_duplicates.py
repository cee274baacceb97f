"""Near duplicates of texts and vectors, and neighbours, against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import D
from tidemark.llm import minhash, queries
from tidemark.llm.ann import build_index, fit_codebook, pack_codes, search
from tidemark.llm.components import UnionFind, components
from tidemark.llm.minhash import BANDS, ROWS, band_keys, near_duplicates, super_minhash
from tidemark.llm.vector_dedup import NEIGHBOURS, cells, cosine, decode, near_vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, k):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def grouped(nodes, links):
    sets = UnionFind()
    for a, b in links:
        sets.union(a, b)
    return {i: sets.find(i) for i in nodes}


def by_brute_force(rows, k):
    sets = sets_of(rows, k)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c, i == c) for i, c in grouped(ids, links).items()}


def told(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_query(spark, docs):
    got = queries.op3_minhash(spark, D)
    assert told(got) == by_brute_force([(r.doc_id, r.text) for r in docs.collect()], 4) and got.count() == docs.count()


def test_five_words(docs):
    assert told(near_duplicates(docs)) == by_brute_force([(r.doc_id, r.text) for r in docs.collect()], 5)


def made_up(seed, groups=12, size=14):
    """Chains and stars of texts at similarities around the threshold, with common passages."""
    rng = np.random.default_rng(seed)
    rows, common = [], [f"c{j}" for j in range(60)]
    for g in range(groups):
        base = [f"g{g}w{j}" for j in range(rng.integers(6, 120))]
        base = base + common if g % 3 == 0 else base
        for _ in range(size):
            words = list(base)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(len(words))] = f"x{rng.integers(1000)}"
            rows.append((len(rows), " ".join(words[: len(words) - int(rng.integers(0, 6))])))
            base = words if g % 2 else base
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_chains_and_common_passages(spark, seed):
    rows = made_up(seed)
    assert told(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == by_brute_force(rows, 5)


def test_mixed_buckets_are_compared_in_blocks(spark):
    """With one slot to a band, texts that share little share buckets; every link is still found."""
    rows = made_up(3, groups=8, size=8)
    made = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=40, rows=1)
    assert told(made) == by_brute_force(rows, 5)


def test_pages_of_one_template_are_compared_in_blocks_of_bounded_members(spark, monkeypatch):
    """Pages that share a passage, most below the threshold, fill common buckets; some are linked by their ends."""
    monkeypatch.setattr(minhash, "MEMBERS", 50)
    rows = [(i, f"click here to read more about our offers of this week in item{i if i % 9 else i - i % 27}" + " now again" * (i % 3 == 0)) for i in range(700)]
    made = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=4)
    assert told(made) == by_brute_force(rows, 4)


def test_ids_with_several_texts_link_through_each(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words[:40]), " ".join(words[20:])
    rows = [(5, a), (5, b), (1, a + " x"), (9, b + " y"), (9, b + " y"), (3, "another text of its own here"), (None, a)]
    made = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [(r[0], r[2]) for r in made] == [(1, 1), (3, 3), (5, 1), (5, 1), (9, 1), (9, 1), (None, None)]


def test_odd_documents(odd):
    made = near_duplicates(odd).collect()
    assert len(made) == odd.count()
    by = {r.doc_id: r for r in made}
    assert by[None].component_id is None and by[None].kept
    for blank in (0, 1, 2, 3):
        assert (by[blank].n_shingles, by[blank].component_id, by[blank].kept) == (0, blank, True)
    assert sum(r.doc_id == 4 and r.kept for r in made) == 3


def test_empty_table(none):
    assert near_duplicates(none).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 150).astype("u8")
        a, b = super_minhash(x[:120], 96), super_minhash(x[30:], 96)
        gaps.append((a == b).mean() - 0.6)
    j = 0.6
    assert abs(np.mean(gaps)) < 0.03 and np.var(gaps) < 1.3 * j * (1 - j) / 96
    assert not np.isinf(super_minhash(x[:1], 96)).any() and np.isinf(super_minhash(x[:0], 4)).all()
    assert len(set(band_keys(a, BANDS, ROWS))) == BANDS


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [tuple(x) for x in rng.integers(200, 260, (30, 2)).tolist()] + [(7, 7), (3, None)]
    want = grouped({x for p in links for x in p if x is not None}, [p for p in links if None not in p])
    made = components(spark.createDataFrame(links, "a long, b long").repartition(7))
    assert {r.node: r.component for r in made.collect()} == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# vectors


def usable(v):
    return v is not None and None not in v and np.isfinite(v).all() and any(v)


def vectors_by_brute_force(rows):
    """Links and groups of (id, vector, label)."""
    fit = [r for r in rows if usable(r[1]) and r[2] is not None]
    links, count = [], Counter()
    for i, (a, x, l) in enumerate(fit):
        for b, y, m in fit[i + 1 :]:
            if l == m and len(x) == len(y) and cosine(np.array([x]), np.array([y]))[0] >= 0.98:
                links.append((a, b))
                count.update((a, b))
    return {i: (count[i], c, i == c) for i, c in grouped([r[0] for r in rows], links).items()}


def vectors_told(frame):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in frame.collect()}


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    assert vectors_told(queries.op9_vector_dedup(spark, D)) == vectors_by_brute_force(rows)


def near(rng, x, least):
    """A vector at a cosine of `least`, or a little more or less, to x."""
    y = rng.normal(size=len(x))
    y -= x * (x @ y) / (x @ x)
    c = least + rng.uniform(-0.004, 0.004)
    return c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * y / np.linalg.norm(y)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(8):
        x = rng.normal(size=16)
        rows += [(len(rows) + i, (near(rng, x, 0.98) * 10.0 ** rng.integers(-3, 4)).tolist(), g % 2) for i in range(9)]
    rows += [(100, None, 0), (101, [], 0), (102, [0.0] * 16, 0), (103, [float("nan")] + [1.0] * 15, 0), (104, [None] + [1.0] * 15, 0), (105, [float("inf")] * 16, 1)]
    rows += [(110 + i, [1e200, 1e199, 0.0], 0) for i in range(3)] + [(113, [1e-200, 1e-201, 0.0], 0), (114, [1.0, 0.1, 0.0], None), (115, [1.0, 0.1], 0), (116, [5e-324, 0.0, 0.0], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, digest string")
    assert vectors_told(near_vectors(frame)) == vectors_by_brute_force(rows)
    assert near_vectors(frame.limit(0)).count() == 0


def test_e8():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) * 2
    p = decode(x)
    assert len(NEIGHBOURS) == 241 and {round(n @ n) for n in NEIGHBOURS[1:]} == {2}
    assert (((x - p) ** 2).sum(1)[:, None] <= ((x[:, None] - p[:, None] - NEIGHBOURS[None]) ** 2).sum(2) + 1e-9).all()
    assert (((2 * p) % 2 == 0).all(1) | ((2 * p) % 2 == 1).all(1)).all() and (p.sum(1) % 2 == 0).all()


def test_no_link_at_the_threshold_is_missed():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = rng.normal(size=x.shape)
    d -= x * (x * d).sum(1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    salt = np.zeros(len(x), "u8")
    from tidemark.llm.vector_dedup import PROBES, TABLES

    (own, probed), (theirs, asked) = cells(x, salt, TABLES, PROBES), cells(y, salt, TABLES, PROBES)
    assert asked.shape == (len(x), TABLES * (PROBES - 1))
    assert all(set(a) & {*b, *d} or set(b) & set(c) for a, b, c, d in zip(own.tolist(), theirs.tolist(), probed.tolist(), asked.tolist()))


def test_ids_with_several_vectors_are_one_node(spark):
    x, y = [1.0, 0.2, 0.3, 0.4], [-0.5, 1.0, 0.1, 0.0]
    rows = [(1, x, 0), (1, None, 0), (1, [1.0, 0.2], 0), (2, x, 0), (2, y, 0), (3, y, 0), (3, y, 1), (4, [2 * v for v in y], 0), (5, x, 1), (5, x, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(tuple(r) for r in near_vectors(frame).collect())
    assert got == sorted([(1, 0, 1, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 2, 1, False), (3, 2, 1, False), (3, 0, 1, False), (4, 2, 1, False), (5, 1, 5, True), (5, 1, 5, True)])


# neighbours


def neighbours(rows, k=10):
    fit = [(i, np.array(v)) for i, v in rows if usable(v)]
    out = {}
    for i, q in fit:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((q - x) ** 2).sum())), j) for j, x in fit if j != i and len(x) == len(q))[:k]
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_neighbours(spark, sf):
    d = D.replace("0.001", sf)
    want = neighbours([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()])
    got = {}
    for r in queries.op10_ann(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    found = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want) / sum(map(len, want.values()))
    assert found >= 0.98
    scores = {(q, j): s for q in want for s, j in want[q]}
    assert all(np.isclose(s, scores[q, j], rtol=1e-12) for q in got for s, j in got[q] if (q, j) in scores)


@pytest.mark.parametrize("dim,share", [(32, 3), (33, 10)])
def test_neighbours_within_a_group_of_near_copies(spark, dim, share):
    """One batch in which a third or a tenth of the rows are near copies: all neighbours are found."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(6000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    group = np.arange(6000) % share == 0
    x[group] = x[0] + rng.normal(size=(group.sum(), dim)) * 1e-3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    index, books = build_index(frame)
    got = {}
    for r in search(index, books, index.where("vec_id % 100 in (0, 1)")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 120
    for i, near in got.items():
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        assert near == np.lexsort((np.arange(6000), far))[:10].tolist(), i


def test_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.5]), (2, [1.0, 0.0, 1.5]), (3, None), (4, [0.0] * 3), (5, [float("nan"), 1.0, 1.0]), (100, [3.0, 4.0]), (200, [None, 1.0, 1.0])]
    index, books = build_index(spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double"))
    made = [tuple(r) for r in search(index, books, index.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert made == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    index, books = build_index(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert search(index, books, index).count() == 0


def test_parallel_errors_are_smaller_than_without_weights():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(book):
        codes = book.encode(x)
        gap = x - book.centres[np.arange(8), codes].reshape(len(x), -1)
        return float(((gap * unit).sum(1) ** 2).mean())

    assert along(fit_codebook(x, 0.5)) < 0.7 * along(fit_codebook(x, 0.0))
    codes = rng.integers(0, 16, (5, 7)).astype("u1")
    packed = pack_codes(codes)
    assert np.stack([packed & 15, packed >> 4], 2).reshape(5, -1)[:, :7].tolist() == codes.tolist()
