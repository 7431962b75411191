"""The pipeline's stages against their operators and brute force, on a small corpus."""

import pytest

import corpus_pipeline
from docpipe.llm import bpe, decontaminate, quality, simhash, suffix_dedup
from docpipe.llm.common import stash


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, small), name)
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "repeat_removal", "decontamination", "tokenize"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and [f.dataType for f in df.schema] == [f.dataType for f in stages[0].schema]


def test_decisions(stages, spark, small):
    ids = [sorted(r.doc_id for r in s.collect()) for s in stages]
    kept = sorted(r.doc_id for r in quality.judged(stages[0]).collect() if r.kept)
    assert ids[1] == kept
    assert ids[2] == sorted({r.component_id for r in simhash.near_duplicates(stages[1]).collect()})
    assert ids[3] == ids[2]
    stripped = {r.doc_id: r for r in suffix_dedup.without_repeats(stages[2]).collect()}
    for r in stages[3].collect():
        assert r.n_chars == len(r.text)
        if not stripped[r.doc_id].n_removed:
            assert len(r.text.encode()) == stripped[r.doc_id].n_bytes
    bad = {r.doc_id for r in decontaminate.leaks(stages[3], spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert ids[4] == [i for i in ids[3] if i not in bad] == ids[5]


def test_tokens(stages):
    import public_tokenizers as P

    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert codec.decode(r.ids) == texts[r.doc_id].encode() and r.n_tokens == len(r.ids)


def test_run(spark, small, stages):
    assert corpus_pipeline.run(spark, small).count() == stages[-1].count()


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
