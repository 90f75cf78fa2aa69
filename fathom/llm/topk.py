"""Exact top-k search: score histograms are refined until each query's k-th value is known, then rows are filtered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import scratch_path, written

K = 5

#: Components are floor(SCALE * x).
SCALE = 256

#: Queries of a block, which goes to every task: with the dimension this bounds what is broadcast.
BLOCK_QUERIES = 2048

#: Candidate vectors scored at once in a task: of plain ones, and of wide ones, whose scores are Python's whole numbers.
CHUNK_ROWS, WIDE_ROWS = 4096, 64

#: Histogram bins of a query in one round: the k-th value's range shrinks by this factor.
BINS = 4096

#: Scores of vectors whose length times largest square is under this are exact as float64; others are wide.
PLAIN_SCORES = 1 << 52

#: Wide scores are first dealt by sign and bit length, this many at most, and their k-th value is settled once no more rows than FEW reach its bin.
BIT_LENGTHS, FEW = 4096, 64

#: Hex digits of a wide score's place in the order: enough for any double's square times any length.
DIGITS = 540

LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, q, d and wide of the vectors that take part: key and all components present and finite.

    q is floor(SCALE * x) / SCALE, which a double holds exactly whatever x is: over 2^45 it is x itself.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.transform("x", lambda v: F.when(F.abs(v) >= float(1 << 45), v).otherwise(F.floor(v * SCALE).cast("double") / SCALE))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & good)
    rows = rows.select("vec_id", whole.alias("q")).withColumn("d", F.size("q"))
    largest = F.coalesce(F.array_max(F.transform("q", lambda v: F.abs(v))), F.lit(0.0)) * SCALE
    return rows.withColumn("wide", F.col("d") * largest * largest >= float(PLAIN_SCORES))


def whole_numbers(q: np.ndarray) -> np.ndarray:
    """The components as Python's whole numbers."""
    out = np.empty(q.shape, object)
    out.flat = [int(v * SCALE) if abs(v) < 1 << 45 else int(v) * SCALE for v in q.ravel().tolist()]
    return out


class Block:
    """Queries of one dimension; lo and hi: where each one's k-th value lies, with ``above`` scores over hi.

    Plain scores are int64, wide ones Python's whole numbers; all else is the same.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, largest: float, wide: bool) -> None:
        order = np.argsort(ids)
        d = q.shape[1]
        self.ids, self.k, self.wide, self.kind = ids[order], k, wide, object if wide else np.int64
        self.q = whole_numbers(q[order]) if wide else q[order] * SCALE
        own = max(map(abs, self.q.ravel().tolist()), default=0)
        bound = int(d * own * max(int(largest) * SCALE + SCALE, 1))
        self.none = -bound - 1  # less than any score
        self.lo, self.hi, self.above = (np.array([v] * len(ids), self.kind) for v in (-bound, bound, 0))

    def width(self) -> np.ndarray:
        return (self.hi - self.lo) // BINS + 1

    def scores(self, ids: np.ndarray, c: np.ndarray) -> np.ndarray:
        """[query, candidate]; a query's own rows score least."""
        if not c.shape[1]:
            s = np.zeros((len(self.ids), len(ids)), self.kind)
        elif self.wide:
            s = self.q @ whole_numbers(c).T
        else:
            s = (self.q @ (c * SCALE).T).astype(np.int64)
        at = np.searchsorted(self.ids, ids)
        own = np.flatnonzero((at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == ids))
        s[at[own], own] = self.none
        return s

    def least(self, s: np.ndarray) -> np.ndarray:
        """Scores under this can't be among the k best: the chunk's own k-th, the known bound, and never a query's own row."""
        n = s.shape[1]
        kth = np.sort(s, axis=1)[:, n - self.k] if self.wide and n > self.k else np.partition(s, n - self.k, axis=1)[:, n - self.k] if n > self.k else self.lo
        return np.maximum(kth, self.lo)


def chunks(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = WIDE_ROWS if wide else CHUNK_ROWS
    for b in batches:
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(ids), rows):
            d = len(flat) // len(ids)
            yield ids[i : i + rows], flat.reshape(len(ids), d)[i : i + rows]


def _signed_bits(scores: np.ndarray) -> np.ndarray:
    return np.array([v.bit_length() if v >= 0 else -v.bit_length() for v in scores.tolist()], np.int64)


def histogram(candidates: DataFrame, block: Block, by_bits: bool = False) -> DataFrame:
    """query, bin, n over all candidates; by_bits: bins are signed bit lengths.

    A chunk leaves out bins under its own k-th score: they can't hold the k-th of all.
    """
    bins = 2 * max(BINS, BIT_LENGTHS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, got, have = block.width(), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            cells, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            return cells, np.bincount(at, np.concatenate([g[1] for g in got])).astype(np.int64)

        for ids, c in chunks(batches, block.wide):
            s = block.scores(ids, c)
            q, j = np.nonzero(s >= block.least(s)[:, None])
            v = s[q, j]
            inside = (v <= block.hi[q]).astype(bool)
            q, v = q[inside], v[inside]
            at = _signed_bits(v) + BIT_LENGTHS if by_bits else ((v - block.lo[q]) // width[q]).astype(np.int64)
            cells, n = np.unique(q * bins + at, return_counts=True)
            got.append((cells, n))
            have += len(cells)
            if have > 2_000_000:
                got = [summed()]
                have = len(got[0][0])
        if got:
            cells, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(cells // bins), pa.array(cells % bins), pa.array(n)], ["query", "bin", "n"])

    return candidates.mapInArrow(rows, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def refine(candidates: DataFrame, block: Block) -> None:
    """Narrows every query's range to its k-th value; at most some rounds of one histogram each.

    A query with fewer than k candidates keeps the whole range below: everything is among its best.
    """
    running = Window.partitionBy("query").orderBy(F.desc("bin"))
    by_bits = block.wide
    while (block.lo < block.hi).any():
        h = histogram(candidates, block, by_bits)
        above = F.sum("n").over(running) - F.col("n")
        start = dict(enumerate(block.above.tolist()))
        width = block.width()
        found = h.withColumn("over", above).withColumn("upto", F.col("over") + F.col("n"))
        had = F.element_at(F.array(*[F.lit(v) for v in start.values()]), (F.col("query") + 1).cast("int")) if any(start.values()) else F.lit(0)
        hit = found.where((F.col("over") + had < block.k) & (F.col("upto") + had >= block.k)).select("query", "bin", "over", "n").collect()
        known = np.zeros(len(block.ids), bool)
        for r in hit:
            known[r.query] = True
            block.above[r.query] += r.over
            if by_bits:
                b = r.bin - BIT_LENGTHS
                lo, hi = (1 << b >> 1, (1 << b) - 1) if b >= 0 else (1 - (1 << -b), -(1 << -b - 1))
            else:
                lo = block.lo[r.query] + r.bin * width[r.query]
                hi = min(block.hi[r.query], lo + width[r.query] - 1)
            few = block.wide and block.above[r.query] + r.n <= FEW
            block.lo[r.query], block.hi[r.query] = lo, lo if few else hi
        by_bits = False
        block.hi[~known] = block.lo[~known]  # fewer than k scores in all


def best(candidates: DataFrame, block: Block, placed: bool) -> DataFrame:
    """query_id, vec_id, score of all scores over the k-th value, and of those equal to it the k smallest ids of each task.

    placed: with the score's place in the order of all whole numbers, as text; else null.
    """
    text = lambda v: format(v + (1 << 4 * DIGITS - 1), f"0{DIGITS}x")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, c in chunks(batches, block.wide):
            order = np.argsort(ids, kind="stable")
            ids, c = ids[order], c[order]
            s = block.scores(ids, c)
            q, j = np.nonzero(s >= block.least(s)[:, None])
            v = s[q, j]
            tie = (v == block.lo[q]).astype(bool)
            first = np.flatnonzero(tie)  # by query, then by id
            rank = np.arange(len(first)) - np.searchsorted(q[first], q[first])
            keep = np.concatenate([np.flatnonzero(~tie), first[rank < block.k]])
            score = v[keep].tolist()
            place = pa.array([text(x) for x in score], pa.string()) if placed else pa.nulls(len(score), pa.string())
            score = pa.array([min(max(x, LEAST_LONG), MOST_LONG) for x in score], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q[keep]]), pa.array(ids[j[keep]]), score, place], ["query_id", "vec_id", "score", "place"])

    return candidates.mapInArrow(rows, "query_id long, vec_id long, score long, place string")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query its k highest integer inner products: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without a
    key. Only vectors of the query's length are its candidates; empty vectors score 0 with each other.
    All rows with the query's key are its own; a repeated query row asks once (the smallest vector);
    other repeated rows are candidates each. Vectors with components so large that a float64 can't
    hold every score (wide) are scored in Python's whole numbers, apart from the rest; ranks follow the exact
    scores, of which ``score`` gives those beyond 64 bits as the nearest long. Queries go through in
    blocks of BLOCK_QUERIES, each one broadcast of bounded size; candidates are only read, never moved.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, key, vector), "quantised")
    asked = written(vectors.where(is_query).transform(lambda d: quantised(d, key, vector)).groupBy("vec_id").agg(F.min(F.struct("q", "d", "wide")).alias("v")).select("vec_id", "v.*"), "queries")
    out = scratch_path(spark, "best")
    spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").write.parquet(out)
    size = F.max(F.coalesce(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q"))), F.lit(0.0)))
    largest = {(r.d, r.wide): r.largest for r in rows.join(F.broadcast(asked.select("d").distinct()), "d").groupBy("d", "wide").agg(size.alias("largest")).collect()}
    for d, wide_query in sorted((r.d, r.wide) for r in asked.select("d", "wide").distinct().collect()):
        kinds = [w for w in (False, True) if (d, w) in largest]
        last = None
        while True:  # by blocks in the order of ids
            mine = asked.where((F.col("d") == d) & (F.col("wide") == wide_query))
            part = (mine if last is None else mine.where(F.col("vec_id") > last)).orderBy("vec_id").limit(BLOCK_QUERIES).select("vec_id", "q").collect()
            if not part:
                break
            last = part[-1].vec_id
            ids, q = np.array([r.vec_id for r in part], np.int64), np.array([r.q for r in part], np.float64).reshape(len(part), d)
            found = None
            for wide in kinds:  # the best of either kind; the best of all are among them
                candidates = rows.where((F.col("d") == d) & (F.col("wide") == wide)).select("vec_id", "q")
                block = Block(ids, q, k, largest[d, wide], wide or wide_query)
                refine(candidates, block)
                own = best(candidates, block, placed=len(kinds) > 1 or wide or wide_query)
                found = own if found is None else found.unionByName(own)
            order = Window.partitionBy("query_id").orderBy(F.desc("place"), F.desc("score"), "vec_id")
            ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)


#: DuckDB: the same rows as op4_top_k, scores beyond 64 bits aside.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CASE WHEN len(a.q) = 0 THEN 0 ELSE CAST(list_dot_product(a.q, b.q) AS BIGINT) END AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 AND len(a.q) = len(b.q)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
