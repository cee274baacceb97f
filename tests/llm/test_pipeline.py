"""The corpus pipeline, stage by stage, against brute-force versions of what each stage decides."""

import re
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import D
from tests.llm.test_near_duplicates import by_brute_force
from tidemark.llm.encode import tokenizer
from tidemark.llm.quality import score_quality
from tidemark.llm.queries import QUERIES, SQL, tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents and what each stage made of them, each reread from Parquet."""
    top = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{D}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], D).write.parquet(path := str(top / re.sub(r"\W", "_", name)))
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    docs = stages[0]
    assert [x.columns for x in stages[1:-1]] == [docs.columns] * 3
    assert [x.dtypes for x in stages[1:-1]] == [docs.dtypes] * 3


def test_quality_stage_keeps_what_scores_well(spark, stages):
    scores = score_quality(stages[0], spark.read.parquet(f"{D}/labels.parquet"))
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}


def test_one_of_each_group_stays(stages):
    want = by_brute_force([(r.doc_id, r.text) for r in stages[1].collect()], 5)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i, (_, _, kept) in want.items() if kept)


def test_pseudonyms_take_effect(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[2:4])
    assert before.keys() == after.keys()
    address = r"[\w.+-]+@[\w-]+\.[a-z]{2,}"
    held = {x for r in before.values() for x in re.findall(address, r.text or "")}
    assert not any(x in (r.text or "") for r in after.values() for x in held)
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
    assert all(after[i].source == r.source and after[i].lang == r.lang for i, r in before.items())


def test_all_ids_are_packed(stages):
    library = tokenizer(tokenizer_path("byte_bpe_50k.json"))
    pieces = {}
    for r in stages[4].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    docs = stages[3].collect()
    assert len(pieces) == len(docs)
    for r in docs:
        ids = np.frombuffer(b"".join(x for _, x in sorted(pieces[r.doc_id])), "<u4").tolist()
        assert ids == [*library.encode(r.text or "", add_special_tokens=False).ids, 0]


def test_run_gives_what_the_stages_give(spark, stages):
    told = lambda x: sorted((r.doc_id, r.start, r.length, zlib.crc32(bytes(r.ids))) for r in x.collect())
    assert sum(n for _, _, n, _ in told(corpus_pipeline.run(spark, D))) == sum(n for _, _, n, _ in told(stages[4]))


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    odd = odd.selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(length(text) as long) n_chars", "1 n_tokens")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, D)
            assert made.columns == docs.columns
            made.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()


def test_registered():
    names = __spark_entry__.queries()
    assert {*QUERIES, "pipeline"} <= names.keys() and SQL.keys() <= QUERIES.keys()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")) == list(range(1, 11))
