import math
import random
import zlib

import pytest
from cases import TEXTS, table
from hypothesis import given
from hypothesis import strategies as st

from fathom.llm.toxicity import Model, drop_toxic, fit, maximal_segments, score_toxicity, tokens_of


def slow_segments(scores):
    """All maximal scoring segments by their definition: the best segment, then those of what is left on either side."""
    best = max(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: (x[0], x[1] - x[2]), default=(0,))
    if best[0] <= 0:
        return []
    s, a, b = best
    return slow_segments(scores[:a]) + [(a, b, s)] + [(x + b, y + b, z) for x, y, z in slow_segments(scores[b:])]


@given(st.lists(st.integers(-6, 9), max_size=14))
def test_segments_match_their_definition(raw):
    scores = [s + k * 0.001 for k, s in enumerate(raw)]  # no ties
    got = maximal_segments(list(enumerate(scores)), -1.0)
    want = slow_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_tokens_between_count_with_the_drift():
    assert maximal_segments([(0, 3.0), (4, 3.0)], -0.5) == [(0, 5, 4.5)]
    assert maximal_segments([(0, 1.0), (9, 3.0)], -0.5) == [(0, 1, 1.0), (9, 10, 3.0)]
    assert tokens_of("abcdef") == ["abcdef", "abcde*", "abcd*"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(300)}x" .replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j") for _ in range(rng.randint(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(("vilething", "vileness", "nastily")))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return table(spark, texts), spark.createDataFrame([*labels, (1, 0, None), (None, 1, 1), (8, 1, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    model = fit(docs, labels)
    out = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert sum(out[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    bad = next(r for i, r in out.items() if truth[i] and r.passages)
    assert bad.passages[0].start < bad.passages[0].end and bad.passages[0].chance <= 0.05
    kept = {r.doc_id for r in drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in out.items() if not r.predicted} and drop_toxic(docs, model).columns == docs.columns


def test_edge_cases(spark, corpus):
    _, labels, _ = corpus
    model = fit(corpus[0], labels)
    out = score_toxicity(table(spark, TEXTS), model).collect()
    assert len(out) == len(TEXTS) and all(r.predicted == 0 for r in out)
    assert score_toxicity(table(spark, []), model).count() == 0
    none = fit(table(spark, TEXTS), labels.limit(0))
    assert {r.score for r in score_toxicity(table(spark, TEXTS), none).collect()} == {0.0}
    assert Model().score(3.0) == 0.0


def test_labels_of_the_fold_teach_nothing(spark, corpus):
    docs, labels, truth = corpus
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit(docs, labels) == fit(docs, flipped)


def slow_evidence(model, n, scores):
    """The sum statistics one r after the other."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += model.rate * s - math.log(model.scale * max(n, 1))
        if total <= 0:
            break
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return best


@given(st.lists(st.floats(0.01, 9), max_size=300), st.integers(0, 3000), st.floats(0.1, 3), st.floats(1e-4, 1))
def test_evidence_counts_every_segment(scores, n, rate, scale):
    model = Model({"a": 1.0}, rate=rate, scale=scale)
    got, want = model.evidence(n, [(0, 0, s) for s in scores]), slow_evidence(model, n, scores)
    assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9)


def test_long_texts_are_scored_whole():
    """Of texts of one length, more passages are more evidence, however many there are."""
    model = Model({"vile": 9.0}, rate=1.0, scale=0.05, slope=1.0, offset=-3.0)
    text = lambda n: " ".join(["vile", *["calm"] * 200] * n + ["calm"] * 201 * (200 - n))
    some = [model.segments(text(n)) for n in (50, 51, 200)]
    assert [(n, len(found)) for n, found in some] == [(201 * 200, k) for k in (50, 51, 200)]
    a, b, c = (model.evidence(100, found) for _, found in some)
    assert a < b < c


def test_extreme_value_rate_solves_its_equation(corpus):
    """Over the clean texts that may be learnt from, the mean of exp(rate * score) is 1, the drift counted for all other tokens."""
    docs, labels, truth = corpus
    model = fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = [w for i, t in texts.items() if not truth[i] and zlib.crc32(str(i).encode()) % 5 for w in texts[i].split()]
    scores = [model.known[w] for w in clean]
    mean = sum(math.exp(model.rate * (s or model.drift)) for s in scores) / len(scores)
    assert abs(mean - 1) < 0.02 or not any(scores)
    assert all(s > 0 for t, s in model.scores.items() if t in ("vilething", "vileness", "nastily", "vile*"))
