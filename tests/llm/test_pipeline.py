import pytest

import corpus_pipeline
from conftest import ODD, words
from daycast.llm import queries
from daycast.llm.common import table

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding"]


def test_every_stage_on_odd_rows(spark, docs, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = docs(ODD)
        out = stage(spark, d, SMALL)
        if k < 4:
            assert out.columns == d.columns
        got = out.collect()
        assert {r.doc_id for r in got} <= {i for i, _ in ODD}
        if k == 4:
            assert len(got) == len(ODD)
        empty = stage(spark, docs([]), SMALL)
        assert empty.count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    a, b = words(*range(80)), words(*range(500, 560))
    rows = [(3, a), (1, a + " end"), (2, a), (4, b), (5, None), (6, None), (None, b)]
    out = corpus_pipeline.dedup_documents(spark, docs(rows), SMALL)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == \
        sorted([(1, a + " end"), (4, b), (5, None), (6, None), (None, b)], key=str)


def test_emptied_documents_go_and_empty_ones_stay(spark, docs):
    line = words(*range(9))
    out = corpus_pipeline.dedup_lines(spark, docs([(1, line), (2, line), (3, ""), (4, line + "\nnew text")]), SMALL)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (line, 1), 3: ("", 1), 4: ("new text", 8)}


def test_whole_pipeline(spark):
    out = queries.QUERIES["pipeline"](spark, SMALL)
    d = table(spark, SMALL, "documents")
    docs, step = d, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        step[name] = docs.count()
    assert sorted((r.doc_id, r.ids_sha256) for r in out.select("doc_id", "ids_sha256").collect()) == \
        sorted((r.doc_id, r.ids_sha256) for r in docs.select("doc_id", "ids_sha256").collect())
    sizes = [d.count(), *step.values()]
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
