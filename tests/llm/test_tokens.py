import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathom.llm.packing import pack_documents, pack_histogram, slots
from fathom.llm.token_counts import count_tokens, vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts(spark, library):
    got = rows(count_tokens(table(spark, TEXTS)), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n, n > 1024) for i, t in TEXTS for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert got == sorted(want, key=repr)
    assert count_tokens(table(spark, [])).count() == 0


def test_all_documents_and_fields(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in count_tokens(docs).collect())


def test_whole_tokens_are_proved(library):
    v = vocabulary("byte_bpe_50k")
    proved = v.whole_tokens
    assert len(proved) > 40_000
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in proved)


def test_every_character_in_several_places(library):
    """What counts as plain is cut as the library cuts it: each character alone, beside letters, digits, spaces and signs."""
    v = vocabulary("byte_bpe_50k")
    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and v.plain(chr(c))]
    assert len(plain) > 30_000
    for i in range(0, len(plain), 200):
        text = "".join(f"a{c}a{c}{c} 1{c}1!{c} {c}\n" for c in plain[i : i + 200])
        want = library.encode(text, add_special_tokens=False).ids
        assert v.ids(text).tolist() == want and v.count(text) == len(want)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab 's\n\t1é<|endoftext|>", max_size=80))
def test_any_text(text):
    v = vocabulary("byte_bpe_50k")
    want = v.library.encode(text, add_special_tokens=False).ids
    assert v.ids(text).tolist() == want and v.count(text) == len(want)


def test_very_long_runs(library):
    v = vocabulary("byte_bpe_50k")
    for text in (" " * 20_000, "a" * 20_000, "\n" * 7000 + "x", "ab" * 10_000 + " " * 6000):
        want = library.encode(text, add_special_tokens=False).ids
        assert v.ids(text).tolist() == want and v.count(text) == len(want)


def one_at_a_time(counts, width):
    """Rooms of the packs when each piece, longest first, goes into the pack with the most room."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            most = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if most is None or rooms[most] < length:
                rooms.append(width)
                most = len(rooms) - 1
            rooms[most] -= length
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 50), max_size=12))
def test_histogram_packing(counts):
    patterns = pack_histogram(counts, 40)
    placed = defaultdict(int)
    for runs, n in patterns:
        assert 0 < sum(x * t for x, t in runs) <= 40 and n > 0
        for x, t in runs:
            placed[x] += n * t
    assert placed == {k: v for k, v in counts.items() if v}
    assert sorted(40 - sum(x * t for x, t in runs) for runs, n in patterns for _ in range(n)) == one_at_a_time(counts, 40)
    by = defaultdict(list)
    for length, a, b, *_ in slots(patterns):
        by[length].append((a, b))
    for length, spans in by.items():
        assert sorted(spans)[0][0] == 0 and all(x[1] == y[0] for x, y in zip(sorted(spans), sorted(spans)[1:], strict=False)) and sorted(spans)[-1][1] == counts[length]


def test_the_shortest_pack_comes_first():
    assert sorted(pack_histogram({900: 1, 700: 1, 100: 1}, 1024)) == [(((700, 1), (100, 1)), 1), (((900, 1),), 1)]
    assert pack_histogram({}, 1024) == []
    assert sum(n for _, n in pack_histogram({x: 10**12 for x in range(1, 1025)}, 1024)) < 1.02 * 10**12 * 1025 / 2


def check_packing(out, texts, library):
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    rows_of = defaultdict(list)
    for r in out:
        ids = want[r.doc_id][0]
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        rows_of[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(len(x) for own in want.values() for x in own)
    for own in rows_of.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(rows_of)


def test_packing(spark, small, library):
    texts = [t for t in TEXTS]
    check_packing(pack_documents(table(spark, texts)).collect(), texts, library)
    assert pack_documents(table(spark, [])).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    out = pack_documents(docs).collect()
    assert len({(r.doc_id, r.start) for r in out}) == len(out)
    sequences = check_packing(out, texts, library)
    assert sequences <= 1.02 * sum(r.length for r in out) / 1024 + 1
