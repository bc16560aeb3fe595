"""The corpus pipeline: every stage's decision takes effect, and columns stay."""

import corpus_pipeline
from llm.cases import awkward, empty

from findery.session import store


def test_stages_filter_what_their_operators_find(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    docs = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = store(stage(spark, docs, sf_dir))
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        docs = kept
    rows = docs.collect()
    texts = ["".join(r.text.split()) for r in rows]
    assert len(set(texts)) == len(texts)
    assert not [r.doc_id for r in rows for t in items if t in r.text]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in rows)


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    for docs in (awkward(spark), empty(spark)):
        given = store(docs)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, sf_dir)
            assert out.columns == docs.columns and out.count() <= given.count()
        corpus_pipeline.STAGES[-1][1](spark, given, sf_dir).collect()
