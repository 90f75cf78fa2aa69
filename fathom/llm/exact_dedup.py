"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import fresh, written

#: Deleted before texts are compared: fixed by the contract, ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"

#: Characters of the normalised text that the second step looks at.
PREFIX_CHARS = 64

#: Bits of the table of surviving (length, prefix) cells: 2 MB, whatever the input. A chance hit costs one full hash, no result.
SURVIVOR_BITS = 1 << 24


def normalised(text: str | Column) -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, "")


def _cell(norm: Column, prefix_chars: int) -> list[Column]:
    return [F.length(norm).alias("norm_length"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("prefix_hash")]


def _bit(length: str, prefix: str) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(SURVIVOR_BITS))


def surviving_cells(docs: DataFrame, text: str, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Steps one and two: lengths that two rows share, then (length, prefix hash) cells that two rows share, as bitmaps.

    Rows are counted by cell before any shuffle; a length held once has only cells held once. The
    result has a fixed number of rows (SURVIVOR_BITS / 32768) of 4 KB at most, so it may be broadcast.
    """
    cells = docs.select(normalised(text).alias("norm")).select(*_cell(F.col("norm"), prefix_chars)).groupBy("norm_length", "prefix_hash").agg(F.count(F.lit(1)).alias("n"))
    bit = cells.where("n > 1").select(_bit("norm_length", "prefix_hash").alias("bit"))
    return bit.groupBy(F.bitmap_bucket_number("bit").alias("bitmap_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def _flagged(docs: DataFrame, text: str, bitmaps: DataFrame, norm: str, survives: str, prefix_chars: int) -> DataFrame:
    """docs with its normalised text and whether its (length, prefix) cell has another row."""
    length, prefix, bit, bucket, bitmap = (fresh(docs, x) for x in ("norm_length", "prefix_hash", "bit", "bitmap_bucket", "bitmap"))
    a, b = _cell(F.col(norm), prefix_chars)
    rows = docs.withColumn(norm, normalised(text)).withColumns({length: a, prefix: b})
    rows = rows.withColumn(bit, _bit(length, prefix)).withColumn(bucket, F.bitmap_bucket_number(bit))
    rows = rows.join(F.broadcast(bitmaps.toDF(bucket, bitmap)), bucket, "left")
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return rows.withColumn(survives, F.coalesce(held, F.lit(False))).drop(length, prefix, bit, bucket, bitmap)


def find_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Per row of docs: key, keep_id, group_size, kept, text_sha256.

    Equal are texts whose normalised forms (SPACES deleted; null: empty) are the same. Of equal rows,
    the one with the most code points in the original text, then the smallest key (null last) stays.
    The full text is hashed only for rows whose (length, prefix) cell is shared, unless digest_all
    asks for the digest of every row; without it, text_sha256 is null for rows that are surely alone.
    Rows that repeat a key and its text count each, and share ``kept``. Other columns are not read.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = _flagged(slim, "text", surviving_cells(slim, "text", prefix_chars), "norm", "survives", prefix_chars)
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    rows = rows.select("key", F.coalesce(F.length("text"), F.lit(0)).alias("points"), "survives", (digest if digest_all else F.when(F.col("survives"), digest)).alias("sha"))
    rows = written(rows, "digests")
    shared = rows.where("survives")
    best = shared.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("points")).alias("a"), F.col("key").isNull().alias("b"), F.col("key").alias("c")))["c"].alias("keep"))
    best = written(best, "groups")  # else it shares the join's exchange, which then can't split a hot text
    out = lambda df, keep, n: df.select(F.col("key").alias(key), keep.alias("keep_id"), n.cast("long").alias("group_size"), F.col("key").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
    return out(rows.where("not survives"), F.col("key"), F.lit(1)).unionByName(out(shared.join(best, "sha"), F.col("keep"), F.col("n")))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows, one. Null, empty and blank texts
    are one text; an empty table gives an empty one.

    Rows that are surely alone pass without a shuffle. Of the others, each map task keeps one per
    text, so a text that a third of all rows hold is no larger group than any other.
    """
    norm, survives, sha, row = (fresh(docs, x) for x in ("norm", "survives", "sha", "row"))
    rows = _flagged(docs, text, surviving_cells(docs, text, prefix_chars), norm, survives, prefix_chars)
    alone = rows.where(~F.col(survives)).select(*docs.columns)
    order = F.struct((-F.coalesce(F.length(text), F.lit(0))).alias("a"), F.col(key).isNull().alias("b"), F.col(key).alias("c"))
    shared = rows.where(F.col(survives)).withColumn(sha, F.sha2(F.col(norm).cast("binary"), 256))
    one = shared.groupBy(sha).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), order).alias(row))
    return alone.unionByName(one.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


#: DuckDB: the same rows as op9_exact_dedup.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, length(x) AS points, sha256(norm) AS sha FROM t),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""
