import random

import numpy as np
import pytest
from cases import TEXTS, table

from fathom.llm.mixing import Rates, fit_rates, mix, mixed_rows

DOMAINS = {"junk": "quality = 0", "good": "quality = 1"}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(500):
        junk = i % 5 == 0
        texts.append((i, " ".join(rng.choice(("###", "$$$", "%%")) if junk and rng.random() < 0.7 else f"word{rng.randrange(50)}" for _ in range(rng.randint(20, 60)))))
        if i % 2:
            labels.append((i, 0 if junk else 1))
    return table(spark, texts), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int"), dict(texts)


def test_targets_are_met(corpus):
    docs, labels, texts = corpus
    out = mix(docs, labels, DOMAINS, (0.4, 0.6)).collect()
    p, rate = np.array([r.posterior for r in out]), np.array([r.rate for r in out])
    tokens = np.array([r.tokens for r in out])
    assert all(r.tokens == len(texts[r.doc_id].split()) for r in out)
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.mean((p[:, 0] > 0.5) == np.array([r.doc_id % 5 == 0 for r in out])) > 0.97
    got = (rate * tokens) @ p
    assert np.allclose(got / tokens.sum(), [0.4, 0.6], atol=1e-3)
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in out)


def test_rates_solve_the_stated_problem(spark):
    """The result is the minimum of the objective: compared with a long plain projected gradient on all documents at once."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet((0.3, 0.3, 0.3), 200)
    tokens = rng.integers(1, 100, 200)
    members = spark.createDataFrame([(int(t), [float(v) for v in x]) for t, x in zip(tokens, p, strict=True)], "tokens long, posterior array<double>")
    have, total = tokens @ p, tokens.sum()
    for limits in ({"high": 2.0, "ridge": 0.05}, {"high": 1.2}, {}):
        rule = fit_rates(members, (0.6, 0.3, 0.1), **limits)
        high, ridge = limits.get("high", np.inf), limits.get("ridge", 0.0)
        rate = np.ones(200)
        for _ in range(20_000):
            miss = ((rate * tokens) @ p - rule.target) / have
            rate = np.clip(rate - (p @ miss + ridge * (rate - 1)) / (1 + ridge), 0, high)
        if ridge:
            assert np.abs(rule.of(p) - rate).max() < 0.02
        loss = lambda r: ((((r * tokens) @ p - rule.target) ** 2 / have).sum() + ridge * (tokens * (r - 1) ** 2).sum()) / total
        assert loss(rule.of(p)) < loss(rate) + 1e-6
        assert np.allclose(rule.reached, (rule.of(p) * tokens) @ p) and np.allclose(rule.have, have)
    assert np.allclose(rule.reached / total, (0.6, 0.3, 0.1), atol=1e-3)


def test_scarce_domains_meet_their_targets(spark):
    """A domain of one token in a hundred gets a tenth: no bound on rates stands in the way; with one, the miss is told."""
    members = spark.createDataFrame([(1, [1.0, 0.0])] * 2 + [(1, [0.0, 1.0])] * 198, "tokens long, posterior array<double>")
    rule = fit_rates(members, (0.1, 0.9))
    assert np.allclose(rule.reached, rule.target, rtol=1e-3) and rule.of(np.array([[1.0, 0.0]]))[0] > 9.9 and len(rule.misses) < 10
    assert fit_rates(members, (0.1, 0.9), high=4.0).reached[0] < 9


def test_rows_are_taken_as_often_as_copies_say(corpus):
    docs, labels, _ = corpus
    limits = {"low": 1.0, "keep_all": True}
    want = {r.doc_id: r.copies for r in mix(docs, labels, DOMAINS, (0.4, 0.6), **limits).collect()}
    rows = mixed_rows(docs, labels, DOMAINS, (0.4, 0.6), **limits)
    assert rows.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert got == want and min(want.values()) >= 1


def test_edge_cases(spark, corpus):
    _, labels, _ = corpus
    out = mix(table(spark, TEXTS), labels, DOMAINS, (0.5, 0.5)).collect()
    assert len(out) == len(TEXTS) and {r.tokens for r in out if r.doc_id in (4, 5, 6)} == {0}
    none = mix(table(spark, TEXTS), labels.limit(0), DOMAINS, (0.5, 0.5)).collect()
    assert {tuple(r.posterior) for r in none} == {(0.5, 0.5)}
    assert mix(table(spark, []), labels, DOMAINS, (0.5, 0.5)).count() == 0
    assert mixed_rows(table(spark, []), labels, DOMAINS, (0.5, 0.5)).count() == 0
    assert np.allclose(Rates(np.ones(2), np.ones(2)).of(np.ones((3, 2))), 1)


def test_unmet_targets_are_logged(corpus, caplog):
    docs, labels, _ = corpus
    with caplog.at_level("INFO"):
        mix(docs, labels, DOMAINS, (0.4, 0.6))
        assert [r.levelname for r in caplog.records if "mixture" in r.message] == ["INFO"]
        mix(docs, labels, DOMAINS, (0.9, 0.1), high=1.5)
    assert [r.levelname for r in caplog.records if "mixture" in r.message] == ["INFO", "WARNING"]
