import re

import corpus_pipeline

from .conftest import wide


def test_stages_on_edge_cases(spark, edge_docs, no_docs, sf_dir):
    for docs in (wide(edge_docs, "row", "at", "fp", "score", "copy", "kept"), no_docs):
        stage = docs
        for name, run in corpus_pipeline.STAGES[:-1]:
            stage = run(spark, stage, sf_dir)
            assert stage.columns == docs.columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, stage, sf_dir)
        if docs is no_docs:
            assert pieces.count() == 0
        else:
            assert {r.doc_id for r in pieces.collect()} <= {r.doc_id for r in docs.collect()}


def test_clean_documents_stay_and_copies_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    good = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    kept = {r.doc_id for r in good.collect()}
    clean = [d for d, q in labels.items() if q == 1 and words[d] >= 50]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)
    told = corpus_pipeline.language(spark, good, sf_dir)
    assert told.count() >= 0.98 * good.count()
    single = corpus_pipeline.near_duplicates(spark, told, sf_dir)
    texts = [r.text for r in single.collect()]
    assert len(set(texts)) == len(texts) and single.count() < told.count()
    assert {r.text for r in single.collect()} <= {r.text for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
