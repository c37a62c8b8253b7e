import corpus_pipeline
from tests.llm.test_ngram_join import brute
from tests.llm.test_secrets import base
from tests.llm.test_tokens import check_packing, plain  # noqa: F401

from cairn.llm import common


def test_stages_against_brute_force(spark, sf, plain, documents):  # noqa: F811
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, sf), "stage")
        seen.append((before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    kept = [(text(a), text(b)) for a, b in seen[:4]]
    assert set(kept[0][1]) <= set(kept[0][0])
    want = brute(kept[1][0])
    assert set(kept[1][1]) == {k for k, v in want.items() if v[0] == k}
    assert kept[2][0].keys() == kept[2][1].keys()
    for k, t in kept[2][0].items():
        assert (kept[2][1][k] == t) if "[SECRET]" not in kept[2][1][k] else base(kept[2][1][k]) == ""
        assert base(t) == "" or kept[2][1][k] != t
    assert set(kept[3][1]) < set(kept[3][0])
    check_packing(seen[4][1].collect(), kept[3][1], plain)


def test_pipeline_of_odd_documents(spark, edge, empty, sf):
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, sf), "stage")
        docs.count()


def test_a_run_drops_what_it_no_longer_reads(spark, sf):
    begin = common.mark()
    assert corpus_pipeline.run(spark, sf).count() > 100
    assert len(common._FOLDERS) - begin <= 2  # the last stage's documents, and its pieces
