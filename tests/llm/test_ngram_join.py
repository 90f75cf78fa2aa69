import random
import re
import string

import numpy as np
from cases import TEXTS, rows, table

from fathom.llm import ngram_join
from fathom.llm.ngram_join import one_of_each, shingle_sets, similarity_components

LOWER = str.maketrans({c: c.lower() for c in string.ascii_uppercase})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = [shingles(t) for _, t in texts]
    group = list(range(len(texts)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        r = root(k)
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return sorted(((i, len(sets[k]), None if least[root(k)][0] else least[root(k)][1]) if sets[k] else (i, 0, i) for k, (i, _) in enumerate(texts)), key=repr)


def found(spark, texts):
    return rows(similarity_components(table(spark, texts)), "doc_id", "n_shingles", "component_id")


def test_edge_cases(spark):
    assert found(spark, TEXTS) == brute(TEXTS)
    assert found(spark, []) == []
    kept = one_of_each(table(spark, TEXTS))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(TEXTS)}


def test_families_near_the_threshold(spark):
    """Families of edited copies, whose pairs lie on both sides of 0.8, a passage that all share, and chains of copies."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(30)]
    texts, n = [], 0
    for f in range(12):
        base = [f"f{f}w{k}" for k in range(rng.choice((40, 80, 150)))]
        for _ in range(14):
            copy = [w if rng.random() > rng.choice((0.0, 0.02, 0.04)) else f"e{rng.random()}" for w in base]
            texts.append((n, " ".join(copy + (passage if rng.random() < 0.7 else []))))
            n += 1
    line = [f"c{k}" for k in range(100)]
    for k in range(25):  # each overlaps with the next only
        texts.append((n + k, " ".join(line[0:0] + [f"c{j}" for j in range(2 * k, 2 * k + 60)])))
    texts += [(900 + k, " ".join(f"u{k}x{j}" for j in range(rng.randint(1, 60)))) for k in range(40)]
    assert found(spark, texts) == brute(texts)


def test_same_result_with_many_fragments(spark, monkeypatch):
    rng = random.Random(4)
    texts = []
    for i in range(150):
        w = [f"b{i % 30}w{k}" for k in range(60)]
        w[rng.randrange(60)] = "edit"
        texts.append((i, " ".join(w)))
    want = brute(texts)
    monkeypatch.setattr(ngram_join, "FRAGMENT", 200)
    monkeypatch.setattr(ngram_join, "PACK_TEXTS", 7)
    monkeypatch.setattr(ngram_join, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(ngram_join, "LIST_ROWS", 2)
    monkeypatch.setattr(ngram_join, "NEAR", 1)
    assert found(spark, texts) == want


def test_a_star_wider_than_the_nearest_look(spark, monkeypatch):
    """Copies that link with their base alone: those far from it in every list are left to the last round."""
    rng = random.Random(6)
    base = [f"s{k}" for k in range(100)]
    texts = [(0, " ".join(base))]
    for i in range(1, 81):
        copy = list(base)
        for k in (rng.randrange(5, 45), rng.randrange(55, 95)):
            copy[k] = f"e{i}x{k}"
        texts.append((i, " ".join(copy)))
    want = brute(texts)
    assert {c for _, _, c in want} == {0}
    monkeypatch.setattr(ngram_join, "NEAR", 1)
    assert found(spark, texts) == want


def test_sets_of_shingles():
    texts = ["A b c D e f", "a B C d E F", " a b ", "", None, "x\x0by\x0cz\rq\tw", "a b c d e f" * 3000, "ÀB"]
    got = list(shingle_sets([None if t is None else t.encode() for t in texts]))
    assert [len(g) for g in got] == [len(shingles(t)) for t in texts]
    assert np.array_equal(got[0], got[1]) and all((np.diff(g.astype(object)) > 0).all() for g in got if len(g) > 1)
    again = list(shingle_sets([b"a b c d e f"]))[0]
    assert np.array_equal(again, got[0])
