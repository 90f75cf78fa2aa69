"""Stages of the pipeline on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import importlib.util
import random

import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not installed")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, length long, keep_id long, component_id long, key string, tokens long"


def rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = " ".join(rng.choices(words, k=60))
    texts = [None, "", "   ", "one", "one two three four", base, base, base.replace(" ", "\n"), base + " end", " ".join(rng.choices(words, k=30_000)), "é" * 5_000]
    out = [(k, t, "en", "s", None, 0.5, 3, 7, 1, 2, "k", 9) for k, t in enumerate(texts)]
    out.append((100, "a row of nulls but for its text and id", *[None] * 10))
    return [*out, out[5]]  # a whole row twice


@pytest.mark.parametrize("stage", ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing"])
def test_stages_keep_columns_and_clean_rows(spark, small, stage):
    import corpus_pipeline as c

    docs = spark.createDataFrame(rows(), SCHEMA)
    out = dict(c.STAGES)[stage](spark, docs, small)
    assert out.columns == docs.columns
    got = out.collect()
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in got} <= whole
    ids = {r.doc_id for r in got}
    if stage == "mixing":
        assert ids == {r[0] for r in rows()}
    if stage == "exact dedup":  # nulls and blanks are one text; base and its copies another; the larger original stays, then the smaller id
        assert sorted(r.doc_id for r in got) == [2, 3, 4, 5, 8, 9, 10, 100]
    if stage == "n-gram Jaccard join":  # texts without words are linked with nothing
        assert {0, 1, 2, 3, 4, 9, 10, 100} <= ids and len(ids & {5, 6, 7, 8}) == 1


def test_packing_takes_every_row(spark, small):
    import corpus_pipeline as c

    docs = spark.createDataFrame(rows(), SCHEMA)
    got = dict(c.STAGES)["packing"](spark, docs, small).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows()} and {r.doc_tokens for r in got if r.doc_id in (0, 1)} == {1}
    room = {}
    for r in got:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in room.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024


@pytest.mark.parametrize("stage", ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "packing"])
def test_empty_tables_give_empty_tables(spark, small, stage):
    import corpus_pipeline as c

    docs = spark.createDataFrame([], SCHEMA)
    out = dict(c.STAGES)[stage](spark, docs, small)
    assert out.count() == 0 and (stage == "packing" or out.columns == docs.columns)
