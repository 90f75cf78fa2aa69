"""Exact Jaccard join of word n-gram sets by vertical partitioning: the n-gram order is cut into fragments, overlaps are counted in each and summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import groups, tidied, tidy, written
from fathom.llm.hashing import BYTE, HASH_BYTES, SPACE, U, mixed, odd, range_hashes

#: Words of an n-gram, and the similarity of a link as a fraction: contract values.
WORDS = 5
ABOVE, BELOW = 4, 5

#: Share of the n-gram order, from its start, that the first look at all texts covers, of 16 parts.
FIRST_PARTS = 5

#: N-grams of a fragment, about: the number of fragments follows the input.
FRAGMENT = 250_000

#: Texts whose n-grams leave a task together, packed by fragment.
PACK_TEXTS = 2000

#: Fragments in which the overlaps of candidate pairs are counted.
COUNT_BITS = 2

#: 64-bit words of a set's bitmap, which bounds overlaps from above.
SKETCH_WORDS = 16

#: Keys that are broadcast to pick texts, a few MB at most; for more the texts are shuffled once.
BROADCAST_KEYS = 1_000_000

#: Counts of n-grams that are broadcast; of more, those of long lists only.
BROADCAST_COUNTS = 100_000

#: Candidate pairs of a round, two numbers each, that are broadcast; more are shuffled.
BROADCAST_PAIRS = 500_000

_PLACE = odd(3, WORDS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of bytes, and where each starts. A-Z are lower-cased; words lie between white space."""
    space = SPACE[data]
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return range_hashes(np.where(space, U(0), BYTE[_LOWER[data]]), first, end), first


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text its set of n-gram hashes, sorted. Fewer words than an n-gram has are one n-gram; no words, none."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at] or b"") < HASH_BYTES):
            part.append(texts[at] or b"")
            size += len(part[-1]) + 1
            at += 1
        data = b"\n".join(part)
        words, first = word_hashes(np.frombuffer(data, np.uint8)) if data else (np.zeros(0, U), np.zeros(0, np.int64))
        bounds = np.searchsorted(first, np.cumsum([0] + [len(p) + 1 for p in part]))
        n = max(0, len(words) - WORDS + 1)
        grams = np.zeros(n, U)
        for k in range(WORDS):
            grams += words[k : k + n] * _PLACE[k]
        grams = mixed(grams)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(grams[a : b - WORDS + 1])
            else:
                yield mixed(np.sum(words[a:b] * _PLACE[: b - a], keepdims=True) + U(b - a)) if b > a else np.zeros(0, U)


def set_id(grams: np.ndarray) -> int:
    """64 bits that stand for a set; equal sets are one in all that follows."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def need(n: int) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-ABOVE * n // BELOW)


# ---- the first look at all texts


def _first_look(docs: DataFrame, bits: int) -> DataFrame:
    """Two kinds of rows. Of each text: key, set, n, part (n-grams in the first FIRST_PARTS/16 of the order).
    Of each fragment there and pack of texts: fragment, sets and runs (which sets have how many n-grams), grams (32 bits each)."""
    kind = docs.schema["key"].dataType.simpleString()
    limit = U(FIRST_PARTS << 60)
    names = ["key", "set", "n", "part", "fragment", "sets", "runs", "grams"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def packs(key_type: pa.DataType) -> pa.RecordBatch:
            ids = np.fromiter(held, np.int64, len(held))
            flat = np.concatenate([*held.values(), np.zeros(0, U)])
            who = np.repeat(np.arange(len(ids)), [len(g) for g in held.values()])
            where = (flat >> U(64 - bits)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            where, who, low = where[order], who[order], (flat[order] >> U(32 - bits)).astype(np.uint32)
            edges = np.flatnonzero(np.diff(np.concatenate([[-1], where, [-1]])))
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                starts = np.flatnonzero(np.diff(np.concatenate([[-1], who[a:b]])))
                runs = np.diff(np.append(starts, b - a)).astype(np.uint32)
                out.append((int(where[a]), ids[who[a:b][starts]].tobytes(), runs.tobytes(), low[a:b].tobytes()))
            none = lambda t: pa.nulls(len(out), t)
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([none(key_type), *[none(pa.int64())] * 3, pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            ids, n, part = [], [], []
            for grams in shingle_sets(b.column(1).to_pylist()):
                first = grams[: np.searchsorted(grams, limit)]
                ids.append(set_id(grams))
                n.append(len(grams))
                part.append(len(first))
                if len(first) and ids[-1] not in held:
                    held[ids[-1]] = first.copy()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (ids, n, part)), pa.nulls(len(n), pa.int64()), *[pa.nulls(len(n), pa.binary())] * 3], names)
            if len(held) >= PACK_TEXTS:
                yield packs(key_type)
                held.clear()
        if held:
            yield packs(key_type)
        tidy()

    return docs.mapInArrow(rows, f"key {kind}, set long, n long, part long, fragment long, sets binary, runs binary, grams binary")


@tidied
def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fragment: set, shared (its n-grams there that another set has too, by 32 bits)."""
    for t in groups(batches, "fragment"):
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in t["sets"].to_pylist()])
        runs = np.concatenate([np.frombuffer(x, np.uint32) for x in t["runs"].to_pylist()])
        grams = np.concatenate([np.frombuffer(x, np.uint32) for x in t["grams"].to_pylist()])
        who = np.repeat(ids, runs)
        order = np.lexsort((who, grams))
        grams, who = grams[order], who[order]
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])])
        grams, who = grams[new], who[new]
        same = grams[1:] == grams[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        ids, n = np.unique(who[twice], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["set", "shared"])


# ---- the survivors


def _packed(where: np.ndarray, ids: np.ndarray, sizes: np.ndarray, who: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows (place, sets, ns, runs, *columns) as bytes, one for each place; who: index into ids and sizes of each n-gram."""
    order = np.lexsort((who, where))
    where, who, columns = where[order], who[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(np.concatenate([[-1], where, [-1]]))).tolist()
    out = []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        starts = np.flatnonzero(np.diff(np.concatenate([[-1], who[a:z]])))
        runs = np.diff(np.append(starts, z - a)).astype(np.uint32)
        own = who[a:z][starts]
        out.append((int(where[a]), ids[own].tobytes(), sizes[own].astype(np.uint32).tobytes(), runs.tobytes(), *(c[a:z].tobytes() for c in columns)))
    return out


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)


def _read(t: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(t[column].to_pylist()), kind)


def _segments(bits: int):
    """Of each fragment of the whole order and pack of texts: fragment, sets, ns, runs, grams (64 bits each)."""
    names = ["fragment", "sets", "ns", "runs", "grams"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def pack() -> pa.RecordBatch:
            size = np.array([len(g) for g in held.values()])
            flat = np.concatenate(list(held.values()))
            return _batch(_packed((flat >> U(64 - bits)).astype(np.int64), np.fromiter(held, np.int64, len(held)), size, np.repeat(np.arange(len(held)), size), flat), names)

        for b in batches:
            for grams in shingle_sets(b.column(0).to_pylist()):
                if len(grams):
                    held.setdefault(set_id(grams), grams)
            if len(held) >= PACK_TEXTS:
                yield pack()
                held.clear()
        if held:
            yield pack()
        tidy()

    return rows


def _shared_segments(bits: int):
    """Of each fragment, without the n-grams that only one set has: by bucket of sets, sets, ns, runs, grams, and df (how many sets have each, at most 65535)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "fragment"):
            ids, at = np.unique(_read(t, "sets", np.int64), return_inverse=True)
            sizes = np.zeros(len(ids), np.uint32)
            sizes[at] = _read(t, "ns", np.uint32)
            who, grams = np.repeat(at, _read(t, "runs", np.uint32)), _read(t, "grams", U)
            order = np.lexsort((who, grams))
            who, grams = who[order], grams[order]
            new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])])
            who, grams = who[new], grams[new]
            _, at, df = np.unique(grams, return_inverse=True, return_counts=True)
            df = df[at]
            keep = df > 1
            who, grams, df = who[keep], grams[keep], np.minimum(df[keep], 65535).astype(np.uint16)
            bucket = (ids[who].view(U) >> U(64 - bits)).astype(np.int64)
            yield _batch(_packed(bucket, ids, sizes, who, grams, df), ["bucket", "sets", "ns", "runs", "grams", "df"])

    return rows


@tidied
def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set with enough of them: its shared n-grams, rarest first, then by hash; its prefix's length in them; its bitmap."""
    for t in groups(batches, "bucket"):
        runs = _read(t, "runs", np.uint32)
        own, grams, df = np.repeat(_read(t, "sets", np.int64), runs), _read(t, "grams", U), _read(t, "df", np.uint16)
        sizes = np.repeat(_read(t, "ns", np.uint32), runs)
        order = np.lexsort((grams, df, own))
        own, grams, sizes = own[order], grams[order], sizes[order]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])).tolist() if len(own) else [0]
        out: list[tuple] = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            n, mine = int(sizes[a]), grams[a:z]
            if len(mine) < need(n):
                continue
            alone = n - len(mine)
            sketch = np.zeros(SKETCH_WORDS, U)
            np.bitwise_or.at(sketch, (mine >> U(6)) % U(SKETCH_WORDS), U(1) << (mine & U(63)))
            out.append((int(own[a]), n, alone, max(0, n - need(n) + 1 - alone), mine.tobytes(), sketch.tobytes()))
        for i in range(0, len(out), 500):
            cols = list(zip(*out[i : i + 500], strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.binary()) for c in cols[4:])], ["set", "n", "alone", "prefix", "grams", "sketch"])


@tidied
def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, n, set, place (in the set's order, n-grams of its own first), alone: of each n-gram of a prefix."""
    for b in batches:
        own, n, alone, prefix = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        k = np.repeat(np.arange(len(own)), prefix)
        if not len(k):
            continue
        grams = np.concatenate([np.frombuffer(g, U)[:p] for g, p in zip(b.column(4).to_pylist(), prefix.tolist(), strict=True)])
        place = np.arange(len(k)) - np.repeat(np.cumsum(prefix) - prefix, prefix) + alone[k]
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n[k]), pa.array(own[k]), pa.array(place), pa.array(alone[k])], ["gram", "n", "set", "place", "alone"])


ENTRY = "gram long, n long, set long, place long, alone long"

#: How candidates are chosen, round by round: neighbours in the order of size; of each set and n-gram the most alike; twice; all that is left.
ROUNDS = ("next", "nearest", "nearest", "all")

#: Sets of one n-gram that a task compares with each other. A longer list is cut into parts of about as many: in the last
#: round every two parts meet in a list of their own, before it parts change with the n-gram and the round.
LIST_ROWS = 500

#: Places in a list, sorted by size, that the nearest is looked for on either side; the last round has no such bound.
NEAR = 1000


def _candidates(how: str):
    """Pairs (a < b, two sets' ids) that share a prefix n-gram, may overlap enough and lie in different components.

    At the first n-gram that both have, no more can follow than the shorter rest of the two; in all
    but the first round bitmaps bound the overlap again. Where two parts of a list meet (side is not
    null), only sets of different parts are compared.
    """

    def block(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        gram, n, own, place, alone, group, side = (t[c].to_numpy() for c in ("gram", "n", "set", "place", "alone", "component", "side"))
        sketch = np.zeros((len(gram), 1), U) if how == "next" else np.frombuffer(b"".join(t["sketch"].to_pylist()), U).reshape(-1, SKETCH_WORDS)
        begin, end = np.searchsorted(gram, gram, "left"), np.searchsorted(gram, gram, "right")
        minor = np.ones(len(gram), bool)
        if how != "next":  # a list's largest component isn't compared with itself
            _, at, size = np.unique(np.stack([begin, group]), axis=1, return_inverse=True, return_counts=True)
            order = np.lexsort((group, -size[at], begin))
            head = order[np.flatnonzero(np.diff(np.concatenate([[-1], begin[order]])))]
            largest = np.zeros(len(gram), np.int64)
            largest[begin[head]] = group[head]
            minor = group != largest[begin]
        pairs, d = [], 0
        best, whom = np.full(len(gram), np.iinfo(np.int64).max), np.full(len(gram), -1)
        up = down = np.flatnonzero(minor)
        reach = {"next": 1, "nearest": NEAR}.get(how, len(gram))
        while (len(up) or len(down)) and d < reach:
            d += 1
            up = up[up + d < end[up]]
            up = up[BELOW * n[up] >= ABOVE * n[up + d]]  # sorted by n: once too long, all later are
            down = down[down - d >= begin[down]] if how != "next" else down[:0]
            down = down[BELOW * n[down - d] >= ABOVE * n[down]]
            back = down[~minor[down - d]]  # of two minor ones, the first has the second above it
            i, j = np.concatenate([up, back - d]), np.concatenate([up + d, back])
            sums = n[i] + n[j]
            least = -(-ABOVE * sums // (ABOVE + BELOW))
            ok = (group[i] != group[j]) & ((side[i] != side[j]) | (side[i] < 0)) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= least)
            i, j, least, sums = i[ok], j[ok], least[ok], sums[ok]
            for at in range(0, len(i), 50_000):
                s = slice(at, at + 50_000)
                x, y = i[s], j[s]
                apart = np.zeros(len(x), np.int64)
                if how != "next":
                    apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) + alone[x] + alone[y]
                    ok = sums[s] - apart >= 2 * least[s]
                    x, y, apart = x[ok], y[ok], apart[ok]
                if how == "nearest":
                    for p, q in ((x, y), (y, x)):
                        nearer = apart < best[p]
                        best[p[nearer]], whom[p[nearer]] = apart[nearer], q[nearer]
                else:
                    pairs.append((own[x], own[y]))
        if how == "nearest":
            x = np.flatnonzero(whom >= 0)
            pairs = [(own[x], own[whom[x]])]
        a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return both[:, 0], both[:, 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in groups(batches, "gram"):
            if t.num_rows > 1:
                held.append(t)
                size += t.num_rows
            if size > 50_000:
                a, b = block(pa.concat_tables(held))
                held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if held:
            a, b = block(pa.concat_tables(held))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows


def _split_lists(placed: DataFrame, how: str, k: int) -> DataFrame:
    """placed with lists of over LIST_ROWS sets cut by a hash of the set, each part a list with a name of its own.

    In the last round a part is compared with itself there (side is -1) and with each other part in a list
    of the two. The rounds before only look for links that join components soon, so there parts stay apart.
    """
    parts = F.ceil(F.col("m") / LIST_ROWS).cast("int")
    if how != "all":
        mine = F.pmod(F.xxhash64("set", "gram", F.lit(k)), parts)
        return placed.withColumn("gram", F.when(parts > 1, F.xxhash64("gram", mine)).otherwise(F.col("gram"))).withColumn("side", F.lit(-1)).drop("m")
    mine = F.pmod(F.xxhash64("set"), parts).cast("int")
    meets = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.xxhash64("gram", F.least(mine, j), F.greatest(mine, j)).alias("gram"), F.when(j == mine, -1).otherwise(mine).alias("side")))
    names = F.when(parts > 1, meets).otherwise(F.array(F.struct(F.col("gram").alias("gram"), F.lit(-1).alias("side"))))
    return placed.withColumn("meet", F.explode(names)).withColumn("gram", F.col("meet.gram")).withColumn("side", F.col("meet.side")).drop("m", "meet")


def _with_counts(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """placed with m of counts (gram, m), n-grams of neither left out.

    Counts are broadcast if a look at their number allows it. Else those of long lists are (there are
    at most as many as LIST_ROWS goes into all entries), so that a common n-gram is never shuffled whole; the rest meets by a shuffle.
    """
    counts = written(counts, "counts")
    if counts.count() <= BROADCAST_COUNTS:
        return placed.join(F.broadcast(counts), "gram")
    long = counts.where(F.col("m") > LIST_ROWS)
    long = F.broadcast(long) if long.count() <= BROADCAST_COUNTS else long
    short = placed.join(long.select("gram"), "gram", "left_anti").join(counts.where(F.col("m") <= LIST_ROWS), "gram")
    return placed.join(long, "gram").unionByName(short)


@tidied
def _counting_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for own, n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            grams = np.frombuffer(blob, U)
            where = (grams >> U(64 - COUNT_BITS)).astype(np.int64)
            out += [(own, n, int(f), g.view(np.int64).tolist()) for f in range(1 << COUNT_BITS) if len(g := grams[where == f])]
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))], ["set", "n", "fragment", "grams"])


def linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that link: partial overlaps are counted fragment by fragment and summed per pair."""
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    second = pairs.join(segments.select(F.col("set").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb")), "b")
    both = second.join(segments.select(F.col("set").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga")), ["a", "fragment"])
    parts = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    sums = parts.groupBy("a", "b").agg(F.sum("part").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return sums.where(BELOW * F.col("both") >= ABOVE * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def components(links: DataFrame, label: str) -> DataFrame:
    """set, component (the smallest set of those that links reach), of every set that has a link.

    Each round hangs every set on its smallest neighbour, follows that pointer twice, and goes on
    with the links between what is left; tables are written each round, nothing comes to the driver.
    """
    links = written(links, f"{label}-links")
    chain = links.select(F.col("a").alias("set")).union(links.select("b")).distinct().withColumn("component", F.col("set"))
    while links.limit(1).count():
        ways = links.union(links.select("b", "a"))
        to = written(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("set"), F.least("a", "b").alias("to")), f"{label}-pointers")
        for _ in range(2):
            to = written(to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.set"), "left").select("x.set", F.coalesce("y.to", "x.to").alias("to")), f"{label}-pointers")
        chain = written(chain.join(to.withColumnRenamed("set", "component"), "component", "left").select("set", F.coalesce("to", "component").alias("component")), f"{label}-components")
        a, b = to.toDF("a", "ta"), to.toDF("b", "tb")
        moved = links.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        links = written(moved, f"{label}-links")
    return chain


def _fragment_bits(grams: float) -> int:
    return max(4, int(np.ceil(np.log2(max(1.0, grams / FRAGMENT)))))


def similarity_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_shingles (n-grams of its text's set), component_id (smallest key reached by links, its own included).

    Two texts link when their sets' Jaccard similarity is ABOVE / BELOW or more; a text without words
    has an empty set and links with nothing, also not with equal texts. Texts of equal sets are one
    from the start. Null keys take part and never name a component that has another key. Rows that
    repeat a key and text repeat their result; if a key has several texts, each row has that of its
    own text. An empty table gives an empty one. Columns other than key and text are not read.

    1. Every text's set is counted, and the n-grams in the first part of the order go to fragments,
       each a task's worth. A text that has more n-grams of its own there than any link may leave
       out can't link; most texts end here. Texts with very few n-grams pass.
    2. The survivors' whole sets go to fragments, and each fragment drops what only one set has. Sets
       with too few left end here. The order of what is left is rarest first.
    3. Sets that share an n-gram of their prefixes are candidates; overlaps are bounded, then counted
       by fragment. Sets already in one component aren't compared, so copies don't make all pairs.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    grams = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / 5
    bits = _fragment_bits(grams * FIRST_PARTS / 16)
    look = written(_first_look(slim, bits), "look")
    texts = look.where("fragment is null").select("key", "set", "n", "part")
    packs = look.where("fragment is not null").select("fragment", "sets", "runs", "grams")
    tasks = 1 << bits
    shared = packs.repartition(tasks, "fragment").sortWithinPartitions("fragment").mapInArrow(_shared_counts, "set long, shared long")
    shared = shared.groupBy("set").agg(F.sum("shared").alias("shared"))
    sets = texts.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.min(F.struct(F.col("key").isNull().alias("k"), F.col("key").alias("v")))["v"].alias("first_key"), F.count(F.lit(1)).alias("copies"))
    sets = written(sets, "sets")
    may = sets.join(shared, "set", "left").where(F.col("part") - F.coalesce("shared", F.lit(0)) <= F.floor(F.col("n") * (BELOW - ABOVE) / BELOW))
    survivors = written(may.select("set", "n", "first_key"), "survivors")
    left = survivors.agg(F.sum("n")).first()[0] or 0
    wanted = written(survivors.select("first_key").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    members = slim.join(wanted, slim["key"].eqNullSafe(wanted["first_key"]), "left_semi")
    bits = _fragment_bits(left)
    packs = members.select("text").mapInArrow(_segments(bits), "fragment long, sets binary, ns binary, runs binary, grams binary")
    shared = packs.repartition(1 << bits, "fragment").sortWithinPartitions("fragment").mapInArrow(tidied(_shared_segments(bits)), "bucket long, sets binary, ns binary, runs binary, grams binary, df binary")
    whole = shared.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(_ordered, "set long, n long, alone long, prefix long, grams binary, sketch binary")
    ordered = written(whole, "ordered")
    parts = ordered.select("set", "n", "grams").mapInArrow(_counting_segments, "set long, n long, fragment long, grams array<long>")
    entries = written(ordered.select("set", "n", "alone", "prefix", "grams").mapInArrow(_prefixes, ENTRY), "prefixes")
    links, found, idle = None, None, None
    for k, how in enumerate(ROUNDS):
        if how == idle:  # nothing has changed since: it would find nothing again
            continue
        if found is None:
            placed = entries.withColumn("component", F.col("set"))
            long = written(placed.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LIST_ROWS), "long-lists")
            long = F.broadcast(long) if long.count() <= BROADCAST_COUNTS else long
            placed = placed.join(long, "gram", "left").withColumn("m", F.coalesce("m", F.lit(1)))  # short lists go as they are
        else:  # only n-grams that still have sets of two components matter, from now on
            placed = entries.join(found, "set", "left").withColumn("component", F.coalesce("component", "set"))
            open_ = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y").select("gram", "m")
            placed = written(_with_counts(placed, open_), "open")
            entries = placed.drop("component", "m")
        if how != "next":
            placed = placed.join(ordered.select("set", "sketch"), "set")
        lists = _split_lists(placed, how, k).repartition("gram").sortWithinPartitions("gram", "n", "set")
        pairs = written(lists.mapInArrow(tidied(_candidates(how)), "a long, b long").distinct(), "pairs")
        if not pairs.limit(1).count():  # of neighbours only: the last round still looks at all that is left
            idle = how
            continue
        new = written(linked(pairs, parts), "links")
        links = new if links is None else links.union(new)
        found = components(links, f"round{k}")
    if found is None:
        found = spark.createDataFrame([], "set long, component long")
    named = sets.join(found, "set", "left").withColumn("component", F.coalesce("component", "set"))
    small = named.groupBy("component").agg(F.min(F.struct(F.col("first_key").isNull().alias("k"), F.col("first_key").alias("v")))["v"].alias("component_id"))
    ids = written(named.join(small, "component").select("set", "component_id"), "names")
    out = texts.where("n > 0").join(ids, "set").select("key", "n", "component_id").unionByName(texts.where("n = 0").select("key", "n", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of docs whose key is its component's smallest, with all their columns.

    Only the keys to drop meet the texts: broadcast while there are at most broadcast_rows of them
    (a few MB), by a shuffle beyond. Rows without words stay, as do rows without a key.
    """
    gone = written(similarity_components(docs, key, text).where(F.col(key) != F.col("component_id")).select(key).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, key, "left_anti").select(*docs.columns)


#: DuckDB: the same rows as op5_ngram_join.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s), e AS MATERIALIZED (SELECT doc_id, hash(unnest(g)) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, both_ways.b FROM r JOIN both_ways ON r.u = both_ways.a)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, min(r.u) AS component_id FROM n JOIN r ON n.doc_id = r.v GROUP BY ALL
"""
