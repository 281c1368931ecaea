from __future__ import annotations

import corpus_pipeline
from plain import WORD, base_secrets, components

from punctual.llm import latent_leaks

FOLDER = "/root/testdata/sf0.001"


def test_run_against_a_plain_version(spark, documents):
    out = corpus_pipeline.run(spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    # all texts are in one of the learned languages: the first stage keeps every one of them
    groups = components(texts.items(), 5, 80)
    first = {i for i, (_, c) in groups.items() if c == i}
    items = [f" {' '.join(latent_leaks.words_of(r['text']))} " for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i for i in first if not any(t in f" {' '.join(latent_leaks.words_of(texts[i]))} " for t in items)}
    ids = {r["doc_id"] for r in out}
    assert ids <= clean and len(ids) == len(out)
    sizes = {i: len(WORD.findall(texts[i])) for i in clean}
    # what the mix leaves out is what its targets do not reach
    assert sum(sizes[i] for i in clean - ids) <= 0.5 * sum(sizes.values())
    assert sum(r["taken"] for r in out) >= 1.4 * sum(r["source_size"] for r in {r["source"]: r for r in out}.values())
    for r in out:
        assert not base_secrets(r["text"])
        if not base_secrets(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]]
    times = [r["position"] for r in out]
    assert all(t is not None for t in times)


def test_stages_keep_columns(spark, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == documents.columns
