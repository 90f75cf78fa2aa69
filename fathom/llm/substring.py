"""Substring dedup: content-defined chunks by a gear rolling hash are deduplicated by digest; what texts with repeated chunks share is then found word by word."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import discard, fresh, groups, tidy, written
from fathom.llm.hashing import BYTE, HASH_BYTES, SPACE, U, range_hashes

#: Words of a passage that counts as repeated, at least, and the least that may be asked for: in fewer, a whole chunk is too rare.
PASSAGE_WORDS, FEWEST = 51, 40

#: Bytes that the rolling hash covers, and one word in how many, on average, ends a chunk.
WINDOW, WORDS_A_CUT = 16, 3

#: Words without a cut after which there is one every so many words: the same words over and over hash alike, and may give none.
NO_CUT, FORCED = 24, 8

#: Bytes of a word, at most: longer runs without white space count as several.
WORD_BYTES = 64

#: Chunks, or passages, of a fragment, about: the number of fragments follows the input.
FRAGMENT = 500_000

#: Chunks, or passages, of texts that leave a task together, packed by fragment.
PACK = 300_000

#: Texts with repeated chunks whose keys and marks are broadcast, and words of each on average, three for a bit: 40 MB at most. For more the texts are shuffled once.
BROADCAST_ROWS, BITS_A_ROW = 500_000, 1_000


@lru_cache(1)
def gear() -> np.ndarray:
    """A fixed random number of 32 bits for each byte value, by a seeded generator."""
    return np.random.Generator(np.random.PCG64(20240101)).integers(0, 1 << 32, 256, np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash h[i] = 2 h[i-1] + gear[byte] over the last WINDOW bytes, summed up by doubling, for all places at once."""
    h, step = gear()[data], 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words of UTF-8 bytes: between white space; characters of scripts that
    don't part words (from U+3000 on) are a word each, and longer words are cut every WORD_BYTES, but within no character."""
    space = SPACE[data]
    start = ~space & np.concatenate([[True], space[:-1]])
    follows = data & 0xC0 == 0x80
    alone = data >= 0xE3
    if alone.any():
        lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(data))))
        start |= alone
        start[1:] |= ~space[1:] & ~follows[1:] & alone[lead[:-1]]
    first = np.flatnonzero(start)
    closing = np.flatnonzero(np.diff(np.concatenate([space, [True]]).view(np.int8)) == 1) + 1
    end = np.minimum(closing[np.searchsorted(closing, first, "right")], np.append(first[1:], len(data))) if len(first) else first
    if (end - first > WORD_BYTES).any():
        again = np.concatenate([np.arange(a, z, WORD_BYTES) if z - a > WORD_BYTES else [a] for a, z in zip(first.tolist(), end.tolist(), strict=True)])
        again = again[~follows[again]]
        end = np.minimum(end[np.searchsorted(first, again, "right") - 1], np.append(again[1:], len(data)))
        first = again
    return first, end


def text_words(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its number, the first bytes and ends of its words, their hashes, and which of them the rolling hash ends a chunk at."""
    at, gap = 0, b"\n" * WINDOW
    while at < len(texts):
        begin, part, size = at, [], 0
        while at < len(texts) and (not part or size + len(texts[at] or b"") < HASH_BYTES):
            part.append(texts[at] or b"")
            size += len(part[-1]) + WINDOW
            at += 1
        data = np.frombuffer(gap + gap.join(part) + gap, np.uint8)  # the hash at a text's start doesn't see the one before
        first, end = word_bounds(data)
        hashes = range_hashes(BYTE[data], first, end)
        cut = rolling(data)[end - 1] < np.uint32((1 << 32) // WORDS_A_CUT)
        offsets = np.cumsum([WINDOW] + [len(p) + WINDOW for p in part])
        bounds = np.searchsorted(first, offsets)
        for k in range(len(part)):
            s = slice(bounds[k], bounds[k + 1])
            yield begin + k, first[s] - offsets[k], end[s] - offsets[k], hashes[s], cut[s]


def chunk_bounds(cut: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of a text's chunks: from each cut, and the text's start, to the first cut, or the
    text's end, that is ``least`` words on. So chunks overlap, and a passage has the same ones in any text, but for its ends."""
    n = len(cut)
    places = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1, [n]]) if n else np.zeros(1, np.int64)
    wide = np.flatnonzero(np.diff(places) > NO_CUT)
    if len(wide):
        places = np.sort(np.concatenate([places, *(np.arange(places[k] + FORCED, places[k + 1], FORCED) for k in wide)]))
    to = np.searchsorted(places, places + least)
    has = to < len(places)
    return places[has], places[to[has]]


def _fragments(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64)


def _bits(rows: float) -> int:
    return max(4, int(np.ceil(np.log2(max(1.0, rows / FRAGMENT)))))


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    new = np.zeros(len(columns[0]) + 1, bool)
    new[[0, -1]] = True
    for c in columns:
        new[1:-1] |= c[1:] != c[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _new_pack() -> int:
    return uuid.uuid4().int >> 65


# ---- chunks


def _chunk_packs(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Two kinds of rows. Of each pack of texts: pack, keys, texts (a hash of each), counts (words) and chunks of its texts, at (chunks that
    another text of the pack has). Of each fragment and pack: fragment, pack, at (chunks, by their number in the pack) and low (32 bits of
    each one's digest). Chunks are deduplicated before they leave: one that many texts hold is one entry for each pack."""
    kind = docs.schema["key"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, counts, held, size, schema = [], [], [], [], 0, None

        def pack() -> pa.RecordBatch:
            name, flat = _new_pack(), np.concatenate(held)
            chunks = [len(h) for h in held]
            who = np.repeat(np.arange(len(held)), chunks)
            order = np.argsort(flat, kind="stable")
            same = flat[order][1:] == flat[order][:-1]
            group = np.cumsum(np.append(True, ~same)) - 1
            start = np.flatnonzero(np.append(True, ~same))
            two = who[order[start]] != who[order[np.append(start[1:], len(order)) - 1]]  # by text within a group
            out = [(name, keys, texts, counts, chunks, None, np.sort(order[two[group]]).astype(np.uint32).tobytes(), None)]
            own = order[start].astype(np.uint32)
            where, low = _fragments(flat[own], bits), (flat[own] >> U(32 - bits)).astype(np.uint32)
            out += [(name, None, None, None, None, int(where[a]), own[a:z].tobytes(), low[a:z].tobytes()) for a, z in _runs(where)]
            return _batch(out, schema)

        for b in batches:
            many = pa.list_(pa.int64())
            schema = schema or pa.schema([("pack", pa.int64()), ("keys", pa.list_(b.column(0).type)), ("texts", many), ("counts", many), ("chunks", many), ("fragment", pa.int64()), ("at", pa.binary()), ("low", pa.binary())])
            names = b.column(0).to_pylist()
            for k, first, _, hashes, cut in text_words(b.column(1).to_pylist()):
                if len(first) < words:
                    continue
                a, z = chunk_bounds(cut, _least(words))
                keys.append(names[k])
                texts.append(_text_hash(hashes))
                counts.append(len(first))
                held.append(range_hashes(hashes, a, z))
                size += len(a)
                if size >= PACK:
                    yield pack()
                    keys, texts, counts, held, size = [], [], [], [], 0
        if held:
            yield pack()
        tidy()

    return docs.mapInArrow(rows, f"pack long, keys array<{kind}>, texts array<long>, counts array<long>, chunks array<long>, fragment long, at binary, low binary")


def _least(words: int) -> int:
    """Words of a chunk, at least, so that a passage of ``words`` words has room for a cut before and after it."""
    return (words - 19) // 2


def _text_hash(hashes: np.ndarray) -> int:
    return int(range_hashes(hashes, np.zeros(1, np.int64), np.array([len(hashes)])).view(np.int64)[0])


def _repeated_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fragment: pack, at (its chunks there that another pack holds too)."""
    for t in groups(batches, "fragment"):
        blobs = t["at"].to_pylist()
        at, low = np.frombuffer(b"".join(blobs), np.uint32), np.frombuffer(b"".join(t["low"].to_pylist()), np.uint32)
        packs, of = t["pack"].to_numpy(), np.repeat(np.arange(len(blobs)), [len(x) // 4 for x in blobs])
        order = np.argsort(low, kind="stable")
        same = low[order][1:] == low[order][:-1]
        hit = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])
        out = [(int(packs[of[hit[a]]]), at[hit[a:z]].tobytes()) for a, z in (_runs(of[hit]) if len(hit) else [])]
        yield _batch(out, pa.schema([("pack", pa.int64()), ("at", pa.binary())]))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text (hash), words, marks (a bit for each chunk) of the texts with repeated chunks, from rows of the same pack."""
    for t in groups(batches, "pack"):
        own = next(k for k, x in enumerate(t["keys"].is_valid().to_pylist()) if x)
        chunks = t["chunks"][own].as_py()
        marks = np.zeros(sum(chunks), bool)
        for x in t["at"].to_pylist():
            marks[np.frombuffer(x, np.uint32)] = True
        ends = np.cumsum(chunks)
        some = [k for k, (z, n) in enumerate(zip(ends.tolist(), chunks, strict=True)) if marks[z - n : z].any()]
        take = lambda c: t[c][own].values.take(pa.array(some, pa.int64()))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([take("keys"), take("texts"), take("counts"), pa.array([np.packbits(marks[ends[k] - chunks[k] : ends[k]]).tobytes() for k in some], pa.binary())], ["key", "text", "words", "marks"])


def candidates(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """key, text (a hash), words, marks (a bit for each chunk, set for the repeated ones) of the texts (docs: key,
    text as binary) that share a chunk with another one: a table."""
    kind = docs.schema["key"].dataType.simpleString()
    bits = _bits((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6 / WORDS_A_CUT)
    packs = written(_chunk_packs(docs, words, bits), "chunks")
    by_fragment = packs.where("fragment is not null").select("fragment", "pack", "at", "low").repartition(1 << bits, "fragment").sortWithinPartitions("fragment")
    found = by_fragment.mapInArrow(_repeated_chunks, "pack long, at binary")
    named = packs.where("fragment is null").select("pack", "keys", "texts", "counts", "chunks", "at").unionByName(found, allowMissingColumns=True)
    out = written(named.repartition("pack").sortWithinPartitions("pack").mapInArrow(_marked, f"key {kind}, text long, words long, marks binary"), "candidates")
    discard(packs)
    return out


# ---- passages


def _places(hashes: np.ndarray, cut: np.ndarray, words: int, marks: list[dict]) -> np.ndarray:
    """First words of a text's passages that hold a repeated chunk; marks: of its key's texts, those with this one's hash count."""
    own = [m["marks"] for m in marks if m["text"] == _text_hash(hashes)] if len(hashes) >= words else []
    if not own:
        return np.zeros(0, np.int64)
    a, z = chunk_bounds(cut, _least(words))
    hit = np.bitwise_or.reduce([np.unpackbits(np.frombuffer(m, np.uint8), count=len(a)) for m in own]).astype(bool)
    digests = range_hashes(hashes, a, z)
    hit = np.isin(digests, digests[hit])  # of equal chunks in a text, one is marked
    a, z, at = a[hit], z[hit], np.arange(len(hashes) - words + 1)
    return at[np.append(z, len(hashes) + words)[np.searchsorted(a, at)] <= at + words]


def _passage_packs(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Passages are runs of ``words`` words with a repeated chunk in them; a pack's equal ones are one, that of the smallest key, before they leave.
    Rows of two kinds: of each fragment and pack its passages: fragment, pack, who and keys (texts), runs (passages of each),
    hashes, firsts and sizes (bytes). Of each pack those that have equals in it, as the former but for hashes: the place of the one
    that leaves, and whether two keys hold it."""
    kind = docs.schema["key"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size, schema = [], [], 0, None

        def pack() -> pa.RecordBatch:
            name = _new_pack()
            flat, first, span = (np.concatenate(c) for c in zip(*held, strict=True))
            who = np.repeat(np.arange(len(held), dtype=np.uint32), [len(h[0]) for h in held])
            names = pa.array(keys, schema.field("keys").type.value_type).to_numpy(zero_copy_only=False)
            rank = np.unique(names, return_inverse=True)[1][who]
            order = np.lexsort((first, who, rank, flat))
            new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
            least = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            last = order[np.append(np.flatnonzero(new)[1:], len(order)) - 1][group]
            two = rank[least] != rank[last]
            own, others = order[new], order[many]
            out = []

            def put(fragment: int | None, at: np.ndarray, equals: np.ndarray) -> None:
                at_who = _runs(who[at])
                texts = [int(who[at[i]]) for i, _ in at_who]
                out.append((fragment, name, np.array(texts, np.uint32).tobytes(), [keys[w] for w in texts], np.array([j - i for i, j in at_who], np.uint32).tobytes(), equals.tobytes(), first[at].tobytes(), span[at].tobytes()))

            where = _fragments(flat[own], bits)
            sort = np.lexsort((first[own], who[own], where))
            own, where = own[sort], where[sort]
            for a, z in _runs(where):
                put(int(where[a]), own[a:z], flat[own[a:z]])
            if len(others):
                sort = np.lexsort((first[others], who[others]))
                equals = _place(who[least], first[least]) | np.where(two, TWO_KEYS, U(0))
                put(None, others[sort], equals[many][sort])
            return _batch(out, schema)

        for b in batches:
            schema = schema or pa.schema([("fragment", pa.int64()), ("pack", pa.int64()), ("who", pa.binary()), ("keys", pa.list_(b.column(0).type)), *((c, pa.binary()) for c in ("runs", "hashes", "firsts", "sizes"))])
            names = b.column(0).to_pylist()
            marks = b.column(2).to_pylist()
            for k, first, end, hashes, cut in text_words(b.column(1).to_pylist()):
                at = _places(hashes, cut, words, marks[k])
                if not len(at):
                    continue
                keys.append(names[k])
                held.append((range_hashes(hashes, at, at + words), first[at].astype(np.uint32), (end[at + words - 1] - first[at]).astype(np.uint32)))
                size += len(at)
                if size >= PACK:
                    yield pack()
                    keys, held, size = [], [], 0
        if held:
            yield pack()
        tidy()

    return docs.mapInArrow(rows, f"fragment long, pack long, who binary, keys array<{kind}>, runs binary, hashes binary, firsts binary, sizes binary")


#: Marks a passage that texts of two keys in its pack hold.
TWO_KEYS = U(1 << 63)


def _place(who: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A passage's text and first byte in one number, by which a pack knows it."""
    return (who.astype(U) << U(32)) | first.astype(U)


def _repeated_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fragment and pack: the passages that texts of two keys hold, by text, with the smallest of the keys."""
    for t in groups(batches, "fragment"):
        read = lambda c, kind: [np.frombuffer(x, kind) for x in t[c].to_pylist()]  # noqa: B023, E731
        all_keys = pa.chunked_array(t["keys"]).combine_chunks().flatten()
        names, rank = np.unique(all_keys.to_numpy(zero_copy_only=False), return_inverse=True)
        whos, runs = read("who", np.uint32), read("runs", np.uint32)
        each = np.concatenate(runs)
        key, who = np.repeat(rank, each), np.repeat(np.concatenate(whos), each)
        at = np.repeat(np.arange(t.num_rows), [int(r.sum()) for r in runs])
        flat, first, size = (np.concatenate(read(c, k)) for c, k in (("hashes", U), ("firsts", np.uint32), ("sizes", np.uint32)))
        order = np.lexsort((key, flat))
        h, k = flat[order], key[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        span = np.diff(np.append(start, len(h)))
        least, most = k[start], k[start + span - 1]
        hit = np.repeat(least != most, span)
        order, least = order[hit], np.repeat(least, span)[hit]
        back = np.lexsort((first[order], who[order], at[order]))
        order, least = order[back], least[back]
        packs, type_ = t["pack"].to_numpy(), t["keys"].type.value_type
        out = []
        for a, z in _runs(at[order]) if len(order) else []:
            mine = order[a:z]
            own = _runs(who[mine])
            uniq, place = np.unique(least[a:z], return_inverse=True)
            out.append((int(packs[at[mine[0]]]), np.array([who[mine[i]] for i, _ in own], np.uint32).tobytes(), names[[key[mine[i]] for i, _ in own]].tolist(), np.array([j - i for i, j in own], np.uint32).tobytes(), first[mine].tobytes(), size[mine].tobytes(), place.astype(np.uint32).tobytes(), names[uniq].tolist()))
        yield _batch(out, pa.schema([("pack", pa.int64()), ("who", pa.binary()), ("keys", pa.list_(type_)), *((c, pa.binary()) for c in ("runs", "firsts", "sizes", "least")), ("names", pa.list_(type_))]))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text and run of overlapping repeated passages a row, from the rows of a pack: passages that fragments
    found repeated (with the smallest key of each), and those that equal others of the pack."""
    for t in groups(batches, "pack"):
        type_ = t["keys"].type.value_type
        blobs = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t[c].to_pylist() if x is not None] or [np.zeros(0, kind)])  # noqa: B023, E731
        values = pa.concat_arrays([x.flatten() for c in ("keys", "names") for x in t[c].chunks])
        names, rank = np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True)
        n_keys, n_names = (np.array([len(x or ()) for x in t[c].to_pylist()]) for c in ("keys", "names"))
        runs = blobs("runs", np.uint32)
        who, key = np.repeat(blobs("who", np.uint32), runs), np.repeat(rank[: n_keys.sum()], runs)
        first, size = blobs("firsts", np.uint32), blobs("sizes", np.uint32).astype(np.int64)
        each = [len(x) // 4 for x in t["firsts"].to_pylist()]
        told = np.repeat([x is not None for x in t["least"].to_pylist()], each)
        place, least = _place(who, first), np.full(len(who), -1)
        base = np.repeat(n_keys.sum() + np.cumsum(n_names) - n_names, each)
        least[told] = rank[blobs("least", np.uint32).astype(np.int64) + base[told]]
        if not told.all():  # those of the pack share the fate of the one that left; if none else has it, their own keys decide
            equal = blobs("equals", U)
            several, equal = equal >= TWO_KEYS, equal & ~TWO_KEYS
            order = np.argsort(place[told])
            left, left_least = place[told][order], least[told][order]
            at = np.searchsorted(left, equal)
            hit = np.append(left, TWO_KEYS)[at] == equal
            _, which = np.unique(equal, return_inverse=True)
            own = np.full(which.max() + 1, len(names))
            np.minimum.at(own, which, key[~told])
            least[~told] = np.where(hit, np.append(left_least, -1)[at], np.where(several, own[which], -1))
        _, at = np.unique(place, return_index=True)  # by text, then by first byte; what left the pack is among its own, too
        at = at[least[at] >= 0]
        who, key, first, end, least = who[at], key[at], first[at].astype(np.int64), (first + size)[at], least[at]
        out = []
        for a, z in _runs(who) if len(who) else []:
            f, e, own = first[a:z], end[a:z], int(key[a])  # ends are in the order of firsts
            for i, j in _cover(f, e):
                elsewhere = np.flatnonzero(least[a + i : a + j] != own) + i
                gone = [(int(f[elsewhere[p]]), int(e[elsewhere[q - 1]] - f[elsewhere[p]])) for p, q in (_cover(f[elsewhere], e[elsewhere]) if len(elsewhere) else [])]
                out.append((*names[[own]].tolist(), int(f[i]), int(e[j - 1]), j - i, *names[[least[a + i : a + j].min()]].tolist(), not gone, [{"first": x, "size": y} for x, y in gone]))
        cuts = pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())]))
        yield _batch(out, pa.schema([("key", type_), ("start", pa.int64()), ("end", pa.int64()), ("n_passages", pa.int64()), ("first_key", type_), ("kept", pa.bool_()), ("cuts", cuts)]))


def _cover(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Which neighbours overlap, one with the next."""
    at = np.flatnonzero(np.concatenate([[True], first[1:] >= end[:-1], [True]])).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each repeated span: key, start and end (bytes of the UTF-8 text), n_passages, first_key, kept, cuts.

    A passage is a run of ``words`` words (as word_bounds() has them; the white space between doesn't count). It repeats if texts of two
    keys hold it, and overlapping repeated passages of a text make a span of n_passages. Each passage
    stays in the text with the smallest key that holds it; first_key is the smallest of those keys in
    the span, cuts the (first, size) of what stays elsewhere, and kept says that there is none.

    Texts are cut where a gear rolling hash says; chunks (of about a third of the words, so that any repeated passage
    has one whole, but with a chance of one in ten thousand) are deduplicated by digest, and only passages around
    repeated chunks are compared whole, which decides. Both times digests are counted by
    fragments of their order, in which a chunk that many texts hold is one entry for each.

    Null and empty texts, and texts of fewer words, have no passage; rows without a key take no part; rows that repeat a key
    and its text share their spans, and don't count as two. An empty table has no span. Other columns are not read.
    """
    if words < FEWEST:
        raise ValueError(f"passages of under {FEWEST} words may hold no chunk")
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).where(F.col("key").isNotNull() & (F.length("text") > 0))
    kind = slim.schema["key"].dataType.simpleString()
    found = candidates(slim, words)
    size = found.agg(F.count(F.lit(1)), F.sum("words")).first()
    marks = found.groupBy("key").agg(F.collect_list(F.struct("text", "marks")).alias("marks"))
    members = slim.join(F.broadcast(marks) if size[0] <= broadcast_rows and (size[1] or 0) <= BITS_A_ROW * broadcast_rows else marks, "key")
    bits = _bits(size[1] or 0)
    packs = written(_passage_packs(members, words, bits), "passages")
    repeated = packs.where("fragment is not null").repartition(1 << bits, "fragment").sortWithinPartitions("fragment").mapInArrow(_repeated_passages, f"pack long, who binary, keys array<{kind}>, runs binary, firsts binary, sizes binary, least binary, names array<{kind}>")
    own = packs.where("fragment is null").select("pack", "who", "keys", "runs", "firsts", "sizes", F.col("hashes").alias("equals"))
    spans = repeated.unionByName(own, allowMissingColumns=True).repartition("pack").sortWithinPartitions("pack").mapInArrow(_spans, f"key {kind}, start long, end long, n_passages long, first_key {kind}, kept boolean, cuts array<struct<first:long,size:long>>")
    return spans.distinct().withColumnRenamed("key", key)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """docs with the text of repeated spans left only where it stays; all other columns and rows as they are.

    Texts with cuts alone are rewritten; a text that is cut whole becomes empty. Rows without a key,
    null and empty texts stay as they are, rows that repeat are cut alike; an empty table gives an empty one.
    """
    spans = repeated_spans(docs, key, text, words).where(~F.col("kept"))
    cuts = fresh(docs, "cuts")
    by_key = spans.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias(cuts))

    @F.pandas_udf("string")
    def without(texts, ranges):
        def one(data, cut):
            if data is None or cut is None:
                return data
            raw, at, out = data.encode(), 0, []
            for c in cut:
                out.append(raw[at : c["first"]])
                at = max(at, c["first"] + c["size"])
            return b"".join([*out, raw[at:]]).decode()

        import pandas as pd

        return pd.Series([one(t, r) for t, r in zip(texts, ranges, strict=True)], dtype=object)

    return docs.join(by_key, key, "left").withColumn(text, F.when(F.col(cuts).isNull(), F.col(text)).otherwise(without(text, cuts))).select(*docs.columns)
