"""Packing, token counts and the token store against the libraries on whole texts."""

import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import D
from tidemark.llm import queries
from tidemark.llm.encode import CountMemo, IdMemo, tokenizer
from tidemark.llm.packing import assign, pack
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.token_store import EliasFano, open_block, pack_block, read_store, write_store

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def ids_of(path, texts):
    return [e.ids for e in tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tab.,!?Zé1'<|>_ 中\x1c"), max_size=60), max_size=5))
def test_memos_give_what_the_library_gives(texts):
    ids, starts = IdMemo.of(BYTES).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == ids_of(BYTES, texts)
    assert CountMemo.of(WORDS).count(texts).tolist() == [len(x) for x in ids_of(WORDS, texts)]


def test_letters_of_all_kinds_are_cut_as_the_library_cuts_them():
    """A character of each small class of letters, marks and blanks beside marks, in both cases of its neighbours."""
    letters = [chr(c) for c in range(0x80, 0x2FFF) if unicodedata.category(chr(c))[0] in "LMZ"] + [chr(c) for c in (*range(0xF900, 0xFB50), *range(0x10400, 0x10450), 0x1F600, 0x1E900, 0x16F40)]
    rng = np.random.default_rng(0)
    texts = [t for c in letters + ["\u0130"] * 50 for t in (f"{c}.", f"a{c}!!", f"'{c}%x", f"{c}\u0307, {c}")]
    texts += ["".join(rng.choice([*letters, ".", ",", "!", " ", "a", "Z", "İ"], 12)) for _ in range(4000)]
    assert CountMemo.of(WORDS).count(texts).tolist() == [len(x) for x in ids_of(WORDS, texts)]
    ids, starts = IdMemo.of(BYTES).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == ids_of(BYTES, texts)


def test_texts_of_one_normal_form_are_encoded_once_and_others_apart(spark, tmp_path):
    texts = ["One two", "one  TWO", "one\ntwo", "one two ", "<|endoftext|>", "<|ENDOFTEXT|>", "J\u030c", "j\u030c", "ΑΣ", "ας", "One two"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "one two"), (None, "one two"), (None, "alone"), (20, "here only")]
    made = count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS, str(tmp_path / "c"))
    want = Counter((i, len(t.encode()), len(x)) for (i, t), x in zip(rows, ids_of(WORDS, [t for _, t in rows])))
    assert Counter(map(tuple, made.collect())) == want
    stored = spark.read.parquet(str(tmp_path / "c"))
    assert stored.count() == stored.select("digest").distinct().count() == 10
    made = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, str(tmp_path / "c"))
    assert Counter(map(tuple, made.collect())) == want and spark.read.parquet(str(tmp_path / "c")).count() == 10


def test_counts_of_odd_texts(odd):
    rows = odd.collect()
    made = count_tokens(odd, WORDS).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(i)) for r, i in zip(rows, ids_of(WORDS, [r.text for r in rows])))
    assert Counter(map(tuple, made)) == want


def test_counts_query(spark, docs):
    rows = docs.collect()
    made = queries.op4_token_counts(spark, D).collect()
    want = {r.doc_id: (len((r.text or "").encode()), len(i), len(i) > 2048) for r, i in zip(rows, ids_of(WORDS, [r.text for r in rows]))}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in made} == want and len(made) == len(rows)


def test_cache_is_joined_and_appended_to(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "three")], "doc_id long, text string")
    assert {tuple(r) for r in count_tokens(first, WORDS, cache).collect()} == {(1, 7, 2), (2, 5, 1), (3, 5, 1)}
    assert spark.read.parquet(cache).count() == 2
    # what is stored is believed, so a count planted there shows that the text was not encoded again
    planted = spark.read.parquet(cache).selectExpr("version", "digest", "n_tokens + 100").collect()
    other = str(tmp_path / "other")
    spark.createDataFrame(planted, "version string, digest binary, n_tokens long").write.parquet(other)
    more = first.union(spark.createDataFrame([(4, "four five six"), (5, None)], first.schema))
    assert {tuple(r) for r in count_tokens(more, WORDS, other).collect()} == {(1, 7, 102), (2, 5, 101), (3, 5, 101), (4, 13, 3), (5, 0, 0)}
    assert spark.read.parquet(other).count() == 4
    # another tokenizer's counts are others
    assert {r.doc_id: r.n_tokens for r in count_tokens(first, BYTES, other).collect()}[1] == len(ids_of(BYTES, ["one two"])[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=60), st.sampled_from([7, 64, 1024]))
def test_assignment_holds_each_id_once(lengths, capacity):
    pieces = assign(np.array(lengths), capacity)
    for d, n in enumerate(lengths):
        own = sorted((s, m) for e, s, m, _, _ in pieces if e == d)
        assert [s for s, _ in own] == list(np.cumsum([0, *(m for _, m in own)])[:-1]) and sum(m for _, m in own) == n
    by = defaultdict(list)
    for _, _, m, s, o in pieces:
        by[s].append((o, m))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(m for _, m in own)])[:-1]) and sum(m for _, m in own) <= capacity
    assert len(by) == -(-sum(lengths) // capacity)


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 400, 4000)
    cost = Counter()
    for _, _, m, s, _ in assign(lengths, 1024):
        cost[s] += m + m * m / 1024
    spread = np.array(list(cost.values()))
    blind = Counter()  # in the order met
    for n, s in zip(lengths, np.cumsum(lengths) // 1024):
        blind[s] += n + n * n / 1024
    assert spread.std() < 0.5 * np.array(list(blind.values())).std()


def packed_well(rows, texts, made):
    want = Counter((k, *x) for k, x in zip([r.doc_id for r in rows], [(len(i) + 1, crc([*i, 0])) for i in ids_of(BYTES, texts)]))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in made:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) <= 1024
    singles = {k for (k, _, _), n in want.items() if sum(c for (d, _, _), c in want.items() if d == k) == 1}
    for k in singles:
        own = sorted(by_doc[k], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        (n, whole) = next((n, c) for d, n, c in want if d == k)
        assert sum(r.length for r in own) == n == own[0].doc_tokens and zlib.crc32(b"".join(bytes(r.ids) for r in own)) == whole
    total = sum(n * c for (_, n, _), c in want.items())
    assert sum(r.length for r in made) == total
    return len(by_seq), total


def test_packing(docs, odd):
    for frame in (docs.coalesce(1), odd.coalesce(1)):
        rows = frame.collect()
        sequences, total = packed_well(rows, [r.text for r in rows], pack(frame, BYTES).collect())
        assert sequences == -(-total // 1024)


def test_small_blocks(docs):
    rows = docs.collect()
    packed_well(rows, [r.text for r in rows], pack(docs, BYTES, block_docs=7).collect())


def test_packing_query(spark, docs):
    made = queries.op1_packing(spark, D).collect()
    ids = dict(zip([r.doc_id for r in docs.collect()], ids_of(BYTES, [r.text for r in docs.collect()])))
    for r in made:
        assert r.ids_crc32 == crc([*ids[r.doc_id], 0][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id]) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano(values):
    values.sort()
    ef = EliasFano.of(np.array(values, "u8"))
    assert ef.values().tolist() == values and [ef.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        ef.select(len(values))
    if values:
        bits = 64 * len(ef.upper) + 8 * len(ef.lower)
        assert bits <= (2 + max(0, np.log2(max(values) / len(values) + 1e-9)) + 1) * len(values) + 200


@given(st.lists(st.lists(st.integers(0, 1 << 20), max_size=9), min_size=1, max_size=20))
def test_blocks_round_trip(lists):
    flat = np.array([x for one in lists for x in one], "<u4")
    ids, ef = open_block(pack_block(flat, np.cumsum([len(x) for x in lists])))
    ends = [0, *(ef.select(i) for i in range(ef.n))]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == lists
    with pytest.raises(ValueError):
        open_block(b"no" + pack_block(flat, np.cumsum([len(x) for x in lists]))[2:])


def test_store_query(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    start, want = 0, []
    for r, ids in zip(rows, ids_of(BYTES, [r.text for r in rows])):
        want.append((r.doc_id, start, len(ids) + 1, crc([*ids, 2])))
        start += len(ids) + 1
    assert [tuple(r) for r in queries.op8_token_store(spark, D).orderBy("doc_id").collect()] == want


def test_store_of_odd_texts(odd):
    rows = sorted(odd.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    made = sorted(read_store(write_store(odd, BYTES, block_ids=50)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in made] == [r.doc_id for r in rows]
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in made] == [[*i, 2] for i in ids_of(BYTES, [r.text for r in rows])]
    assert [r.start for r in made] == list(np.cumsum([0, *(r.n_tokens for r in made)])[:-1])
    assert [len(r.ids) // 4 for r in read_store(write_store(odd, BYTES, end_id=None)).collect()].count(0) == 2


def test_empty_tables(none):
    assert pack(none, BYTES).count() == count_tokens(none, WORDS).count() == read_store(write_store(none, BYTES)).count() == 0
