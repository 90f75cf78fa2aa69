import importlib.util

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not installed")


def test_stages(spark, small):
    import corpus_pipeline as c
    from test_ngram_join import brute, shingles

    from fathom.llm.common import written
    from fathom.llm.exact_dedup import find_copies
    from fathom.llm.toxicity import fit, score_toxicity

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stages = dict(c.STAGES)
    assert [n for n, _ in c.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    clean = written(stages["toxicity"](spark, docs, small), "t")
    scored = {r.doc_id: r.predicted for r in score_toxicity(docs, fit(docs, labels)).collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, p in scored.items() if not p}
    once = written(stages["exact dedup"](spark, clean, small), "t")
    assert {r.doc_id for r in once.collect()} == {r.doc_id for r in find_copies(clean).collect() if r.kept}
    apart = written(stages["n-gram Jaccard join"](spark, once, small), "t")
    texts = [(r.doc_id, r.text) for r in once.collect()]
    assert {r.doc_id for r in apart.collect()} == {comp for _, _, comp in brute(texts)} and shingles("")== set()
    mixed = written(stages["mixing"](spark, apart, small), "t")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in apart.collect()}
    packed = stages["packing"](spark, mixed, small)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert packed.count() == c.run(spark, small).count()


def test_registered(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
