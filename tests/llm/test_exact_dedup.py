import hashlib
import random
import re

from cases import TEXTS, rows, table

from fathom.llm.exact_dedup import drop_copies, find_copies


def expected(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0]))[0]
        out += [(i, keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in own]
    return sorted(out, key=repr)


NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_edge_cases(spark):
    docs = table(spark, TEXTS)
    assert rows(find_copies(docs, digest_all=True), *NAMES) == expected(TEXTS)
    assert find_copies(table(spark, []), digest_all=True).count() == 0
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for _, k, *_ in expected(TEXTS)} and kept.count() == len({e[4] for e in expected(TEXTS)})


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab \n") for _ in range(rng.choice((0, 3, 3, 4, 70, 71, 200))))) for i in range(600)]
    texts += [(1000 + i, "hot text") for i in range(300)] + [(2000 + i, "x" * 64 + rng.choice("yz")) for i in range(100)]
    assert rows(find_copies(table(spark, texts), digest_all=True), *NAMES) == expected(texts)
    lazily = {r.doc_id: r for r in find_copies(table(spark, texts)).collect()}
    want = {e[0]: e for e in expected(texts)}
    assert all((r.keep_id, r.group_size, r.kept) == want[i][1:4] for i, r in lazily.items())
    assert all(r.text_sha256 is not None for r in lazily.values() if r.group_size > 1)
    assert drop_copies(table(spark, texts)).count() == len({e[4] for e in want.values()})
