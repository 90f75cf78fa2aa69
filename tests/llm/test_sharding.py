import zlib
from collections import Counter

from cases import TEXTS, rows, table
from pyspark.sql import functions as F

from fathom.llm.common import gapless_rank, written
from fathom.llm.sharding import assign_shards, shard_documents


def test_documents(spark):
    out = shard_documents(table(spark, TEXTS)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is not None) == sorted((i, size(t), zlib.crc32((t or "").encode())) for i, t in TEXTS if i is not None)
    for shard in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))
    assert all(r.law == "key" and 0 <= r.shard < 8 for r in out)
    assert len({r.shard for r in out if r.doc_id == 7}) == 1
    assert shard_documents(table(spark, [])).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    out = shard_documents(spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    assert 0.08 < sum(r.grown_shard == 8 for r in out) / 5000 < 0.15
    assert max(Counter(r.shard for r in out).values()) < 1.2 * 5000 / 8


def test_weights(spark):
    df = spark.range(20000).withColumn("shard", F.lit("old"))
    counts = Counter(r.shard for r in assign_shards(df, "id", [1, 3, 0, 2]).collect())
    assert set(counts) == {0, 1, 3}
    assert abs(counts[1] / 20000 - 0.5) < 0.02 and abs(counts[0] / 20000 - 1 / 6) < 0.02
    before, after = (dict(rows(assign_shards(df, "id", w), "id", "shard")) for w in ([1, 3, 1], [1, 4, 1]))
    assert all(after[k] in (v, 1) for k, v in before.items())


def test_ranks_with_many_buckets_and_equal_rows(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") % 700).alias("v"))
    df = written(df.withColumn("h", F.shiftrightunsigned(F.xxhash64("v"), 4)), "test")
    out = gapless_rank(df, "g", {0: 1500, 1: 1500}, "h", ["v"], "r", per_bucket=50).collect()
    assert len(out) == 3000
    for g in (0, 1):
        assert sorted(r.r for r in out if r.g == g) == list(range(1500))
