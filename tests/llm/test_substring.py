import random

import numpy as np
import pytest
from cases import TEXTS, table

from fathom.llm import substring
from fathom.llm.substring import chunk_bounds, cut_repeats, gear, repeated_spans, rolling, text_words, word_bounds


def brute(texts, words=51):
    """Spans by comparing every run of words of every text: {(key, start, end, first_key, kept, cuts)}."""
    split = []
    for key, t in texts:
        data = (t or "").encode()
        first, end = word_bounds(np.frombuffer(data, np.uint8)) if data else ((), ())
        split.append((key, [data[a:z] for a, z in zip(first, end, strict=True)], list(first), list(end)))
    holders = {}
    for key, w, *_ in split:
        for i in range(len(w) - words + 1):
            holders.setdefault(tuple(w[i : i + words]), set()).add(key)
    out = set()
    for key, w, first, end in split:
        if key is None:
            continue
        spans, cuts = [], []
        for i in range(len(w) - words + 1):
            own = holders[tuple(w[i : i + words])] - {None}
            if len(own) < 2:
                continue
            a, z = int(first[i]), int(end[i + words - 1])
            if spans and a < spans[-1][1]:
                spans[-1][1:] = [z, min(spans[-1][2], min(own)), spans[-1][3]]
            else:
                spans.append([a, z, min(own), []])
            if min(own) != key:
                cuts = spans[-1][3]
                if cuts and a < cuts[-1][1]:
                    cuts[-1][1] = z
                else:
                    cuts.append([a, z])
        out |= {(key, a, z, least, not cuts, tuple((x, y - x) for x, y in cuts)) for a, z, least, cuts in spans}
    return out


def found(spark, texts, **kw):
    return {(r.doc_id, r.start, r.end, r.first_key, r.kept, tuple((c["first"], c["size"]) for c in r.cuts)) for r in repeated_spans(table(spark, texts), **kw).collect()}


def some_words(rng, letters="abcdefghijklmnopé"):
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    return lambda n: " ".join(word() for _ in range(n))


def test_the_rolling_hash_and_its_cuts():
    """Against a plain loop over the bytes, and cuts against a plain look at each word's end."""
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    g = gear().tolist()
    want = [sum(g[data[i - j]] << j for j in range(min(i + 1, substring.WINDOW))) % 2**32 for i in range(len(data))]
    assert rolling(data).tolist() == want
    text = some_words(random.Random(2))(2000).encode()
    (_, first, end, hashes, cut), = text_words([text])
    raw = b"\n" * 16 + text
    for e, c in zip(end.tolist(), cut.tolist(), strict=True):
        h = sum(g[raw[e + 15 - j]] << j for j in range(16)) % 2**32
        assert c == (h < 2**32 // 3)
    assert [text[a:z] for a, z in zip(first, end, strict=True)] == text.split() and len(set(hashes.tolist())) == len(set(text.split()))
    a, z = chunk_bounds(cut, 16)
    assert a[0] == 0 and (z - a >= 16).all() and all(cut[x - 1] or x % 8 == 0 for x in a[1:]) and 500 < len(a) < 900


def test_words():
    cases = {"": [], " a  b\n": ["a", "b"], "ab 日本x語 y": ["ab", "日", "本", "x", "語", "y"], "é" * 70 + " z": ["é" * 32, "é" * 32, "é" * 6, "z"]}
    for text, want in cases.items():
        data = text.encode()
        first, end = word_bounds(np.frombuffer(data, np.uint8))
        assert [data[a:z].decode() for a, z in zip(first, end, strict=True)] == want


def test_insertions_move_few_chunks():
    rng = random.Random(2)
    some = some_words(rng)
    text = some(3000)
    sets = []
    for t in (text, some(5) + " " + text[:100] + " inserted words " + text[100:]):
        (_, _, _, hashes, cut), = text_words([t.encode()])
        sets.append({tuple(hashes[a:z].tolist()) for a, z in zip(*chunk_bounds(cut, 16), strict=True)})
    assert len(sets[0] & sets[1]) > 0.97 * len(sets[0])


def corpus(seed):
    """Passages of 30 to 80 words planted in several texts, texts copied with single words changed, texts that share nothing, a passage that a third holds."""
    rng = random.Random(seed)
    some = some_words(rng)
    passages = [some(rng.randint(30, 80)) for _ in range(40)]
    common = some(60)
    texts = []
    for i in range(240):
        t = [some(rng.randint(1, 90)), some(rng.randint(1, 90))]
        if rng.random() < 0.5:
            t.insert(1, rng.choice(passages))
        if rng.random() < 0.33:
            t.append(common)
        texts.append((i, " ".join(t)))
    for i in range(60):
        w = rng.choice(texts)[1].split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit"
        texts.append((1000 + i if i % 2 else -1000 - i, " ".join(w)))
    texts += [(5000 + i, " ".join([some(3), *["an"] * (70 + 5 * i), some(4)])) for i in range(4)]
    texts += [(6000 + i, "".join(chr(0x4E00 + (k * k + 7 * i * (k < 10)) % 5000) for k in range(90))) for i in range(3)]
    return [*texts, texts[3], (7, texts[3][1]), (None, common), (8000, None), (8001, "")]


def test_against_brute_force(spark):
    texts = corpus(1)
    want = brute(texts)
    assert len(want) > 200 and any(c and k != min(k, f) for k, _, _, f, _, c in want)
    assert found(spark, texts) == want
    assert found(spark, texts, broadcast_rows=0) == want


def test_texts_of_many_packs_and_fragments(spark, monkeypatch):
    texts = [(str(k) if k is not None else None, t) for k, t in corpus(2)]
    docs = spark.createDataFrame(texts, "doc_id string, text string").repartition(7)
    monkeypatch.setattr(substring, "FRAGMENT", 100)
    got = {(r.doc_id, r.start, r.end, r.first_key, r.kept, tuple((c["first"], c["size"]) for c in r.cuts)) for r in repeated_spans(docs).collect()}
    assert got == brute(texts)


def test_short_passages_are_all_found(spark):
    """Each passage of 51 to 60 words stands in two texts between different neighbours; not one may be missed, and none of 40 to 50 is told."""
    rng = random.Random(7)
    some = some_words(rng)
    texts, want = [], set()
    for i in range(800):
        n = 51 + i % 10 if i % 2 else 40 + i % 11
        passage = some(n)
        for k in (2 * i, 2 * i + 1):
            left = some(rng.randint(5, 40)) + " "
            texts.append((k, left + passage + " " + some(rng.randint(5, 40))))
            if n > 50:
                want.add((k, len(left.encode()), len((left + passage).encode()), 2 * i))
    assert {r[:4] for r in found(spark, texts)} == want


def test_edge_cases(spark):
    assert found(spark, TEXTS) == brute(TEXTS) and {r[0] for r in brute(TEXTS)} == {7, 8}
    assert repeated_spans(table(spark, [])).count() == 0
    assert found(spark, [(1, "abc " * 500), (1, "abc " * 500)]) == set()
    texts = corpus(3)[:150]
    assert found(spark, texts, words=40) == brute(texts, 40)
    with pytest.raises(ValueError):
        repeated_spans(table(spark, []), words=39)


def test_cutting_leaves_each_passage_once(spark):
    rng = random.Random(5)
    some = some_words(rng, "abcdefgéö")
    passage = some(80)
    texts = [(i, some(60) + " " + passage + " " + some(60)) for i in range(5)] + [(9, None), (10, "alone"), (None, passage)]
    docs = table(spark, texts)
    out = cut_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    got, was = {r.doc_id: r.text for r in out.collect()}, dict(texts)
    assert got[0] == was[0] and got[9] is None and got[10] == "alone" and got[None] == passage
    for i in range(1, 5):
        assert got[i].split() == was[i].replace(passage, "").split()
