"""Rendezvous hashing of record keys over weighted shards. Native: DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import HASH_BITS, fresh, gapless_rank, md5_60, written

LAW = "key"


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: every shard draws u from (0, 1) by hashing (key, shard); the largest weight / -ln(u) wins.

    Equal scores go to the larger shard number. A shard of weight 0 gets nothing. Adding a shard
    moves only the keys that it wins; raising one weight moves keys only to that shard. A null key
    counts as the text 'null'.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, and one above 0")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    if len({w for w in weights if w > 0}) == 1:  # equal weights: the order of u is the order of the scores
        score = lambda k, w: md5_60(F.concat(text, F.lit(f"#{k}")))
    else:
        score = lambda k, w: F.lit(float(w)) / -F.log((md5_60(F.concat(text, F.lit(f"#{k}"))) + F.lit(0.5)) / F.lit(float(2**HASH_BITS)))
    drawn = [F.struct(score(k, w).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    return (F.greatest(*drawn) if len(drawn) > 1 else drawn[0])["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """df with the column ``shard``; no shuffle. An older column of that name is replaced.

    Nulls, repeated rows and empty tables need nothing special: equal keys share a shard.
    """
    return df.withColumn(shard, rendezvous(F.col(key), weights))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key law: doc_id and the shard count decide. size is the UTF-8 bytes plus 1 (null text: 1),
    text_crc32 that of the bytes (null text: of none). slot numbers each shard's rows without gaps by
    a hash of the row. Repeated rows each get a slot. Texts don't enter any shuffle. Columns of docs
    other than doc_id and text are not read.
    """
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"),
    )
    put = slim.withColumn("shard", rendezvous(F.col("doc_id"), [1] * shards)).withColumn("grown_shard", rendezvous(F.col("doc_id"), [1] * (shards + 1)))
    whole = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32")
    spread = fresh(put, "spread")
    put = written(put.withColumn(spread, md5_60(whole)), "shards")
    sizes = {r["shard"]: r["count"] for r in put.groupBy("shard").count().collect()}  # as many rows as shards
    ranked = gapless_rank(put, "shard", sizes, spread, ["doc_id"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")


def sql(shards: int = 8) -> str:
    """DuckDB: the same rows as op3_sharding. CRC-32 is folded over the bytes with its table, itself made by eight steps a byte."""
    digest = lambda text: f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
    drawn = lambda k: f"{{'score': {digest(key + f" || '#{k}'")}, 'shard': {k}}}"
    key = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
    best = lambda n: f"list_max([{', '.join(map(drawn, range(n)))}]).shard"
    return f"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i)) AS t),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
k AS (SELECT doc_id, size, xor(list_reduce(b, lambda x, y: xor(x // 256, t[xor(x, y) % 256 + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, c),
s AS (SELECT *, {best(shards)} AS shard, {best(shards + 1)} AS grown_shard, {digest(key + " || ':' || size || ':' || text_crc32")} AS h FROM k)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM s
"""
