"""Shortest-pack-first packing over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import fresh, gapless_rank, tidy, written
from fathom.llm.token_counts import vocabulary

#: Tokens of a sequence.
WIDTH = 1024

#: The id that ends a document.
END_ID = 0


#: A pattern: runs of (length, how many in a row), and how many sequences have it.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def pack_histogram(counts: dict[int, int], width: int) -> list[Pattern]:
    """Patterns for counts pieces of each length, by shortest pack first.

    Lengths are placed longest first, each piece into the shortest pack, the one with the most room;
    if it doesn't fit there, it fits nowhere and opens a pack. Packs of equal room take pieces
    together and equal packs are one pattern with a count, so the work follows the number of
    lengths, never the number of pieces.
    """
    open_packs: dict[int, list[Pattern]] = defaultdict(list)  # by room left
    done: list[Pattern] = []

    def put(runs: tuple[tuple[int, int], ...], room: int, n: int) -> None:
        if room:
            open_packs[room].append((runs, n))
        else:
            done.append((runs, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        if not 0 < length <= width or left < 0:
            raise ValueError(f"{left} pieces of length {length} don't go into {width}")
        for room in range(width - 1, length - 1, -1):  # packs that take a piece come up again with less room
            if not left:
                break
            if not open_packs[room]:
                continue
            packs, open_packs[room] = open_packs[room], []
            below = next((r for r in range(room - 1, length - 1, -1) if open_packs[r]), 0)
            every = sum(n for _, n in packs)
            times = min(left // every, -(-(room - below) // length), room // length)
            for runs, n in packs:  # all of them are the shortest, until they have grown past the next ones
                if times:
                    left -= times * n
                    put((*runs, (length, times)), room - times * length, n)
                else:
                    some = min(left, n)
                    left -= some
                    if some:
                        put((*runs, (length, 1)), room - length, some)
                    if n > some:
                        put(runs, room, n - some)
        if left:  # a new pack is the shortest, until it is full
            each = width // length
            if left // each:
                put(((length, each),), width - each * length, left // each)
            if left % each:
                put(((length, left % each),), width - left % each * length, 1)
    return done + [p for packs in open_packs.values() for p in packs]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces in a row, first sequence, offset): which ranks of a length lie where."""
    out, taken, base = [], defaultdict(int), 0
    for runs, n in patterns:
        offset = 0
        for length, times in runs:
            out.append((length, taken[length], taken[length] + n * times, times, base, offset))
            taken[length] += n * times
            offset += length * times
        base += n
    return out


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", width: int = WIDTH) -> DataFrame:
    """Per piece of a document's ids (with END_ID at the end): key, start, length, ids_crc32, doc_tokens; no shuffle."""
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = vocabulary(name), END_ID.to_bytes(4, "little")
        for b in batches:
            at, out = [], ([], [], [], [])
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = memoryview((own.ids(t).astype("<u4", copy=False).tobytes() if t else b"") + end)
                total = len(ids) // 4
                for start in range(0, total, width):
                    part = ids[4 * start : 4 * (start + width)]
                    at.append(k)
                    for x, v in zip(out, (start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in out)], ["key", "start", "length", "ids_crc32", "doc_tokens"])
        tidy()

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(rows, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("key", key)


def pack(cut: DataFrame, length: str = "length", width: int = WIDTH) -> DataFrame:
    """cut (a table, read more than once) with sequence_id and offset.

    Rows that repeat are pieces each; nulls in other columns and an empty table need nothing special;
    a length that is null, under 1 or over width is an error. Older columns of the two names must not exist.

    Only the histogram (width rows at most) comes to the driver, and only the pattern slots (bounded
    by the lengths, not the pieces) are broadcast. Pieces meet their slots by rank among the pieces
    of their length.
    """
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy(length).count().collect()}
    spread, rank = fresh(cut, "spread"), fresh(cut, "rank")
    hashed = cut.withColumn(spread, F.shiftrightunsigned(F.xxhash64(*cut.columns), 4))
    ranked = gapless_rank(hashed, length, counts, spread, [c for c in cut.columns if c != length], rank)
    names = [fresh(cut, x) for x in ("slot_length", "first_rank", "end_rank", "slot_times", "first_sequence", "slot_offset")]
    where = spark.createDataFrame(slots(pack_histogram(counts, width)), ", ".join(f"{x} long" for x in names))
    a, lo, hi, times, base, offset = map(F.col, names)
    joined = ranked.join(F.broadcast(where), (F.col(length) == a) & (F.col(rank) >= lo) & (F.col(rank) < hi))
    sequence = base + F.floor((F.col(rank) - lo) / times)
    return joined.select(*cut.columns, sequence.cast("long").alias("sequence_id"), (offset + (F.col(rank) - lo) % times * F.col(length)).alias("offset"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", width: int = WIDTH) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and END_ID; null and empty texts are END_ID alone. Long documents are cut
    every ``width`` ids. Rows that repeat are packed each. An empty table packs into no sequence.
    Columns other than key and text are not read.
    """
    return pack(written(pieces(docs, key, text, name, width), "pieces"), width=width)
