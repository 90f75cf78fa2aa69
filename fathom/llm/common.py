"""What the operators share: tables, the shared folder, written intermediates and gapless ranks."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Only for a local session without spark.checkpoint.dir, as in tests: there the driver and its workers share it.
LOCAL_SHARED = "/tmp/checkpoints"

#: Rows of an Arrow batch that goes to Python: texts may be long, so few.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, which a cluster must name."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/fathom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the rows of Arrow batches while it is open; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if 0 < int(own) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of BATCH_ROWS: what a worker makes of texts at once stays small, whatever the session sets."""
    for b in batches:
        for k in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(k, BATCH_ROWS)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing will read again: all that came of it must be written itself."""
    _delete(table.sparkSession, table._written_at)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results that read it are void after."""
    _delete(spark, f"{shared_dir(spark)}/fathom-{spark.sparkContext.applicationId}")


def at_most(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df if it has no more rows than that; else those with the smallest hashes of key, so many that their number stays under it.

    The bound is a threshold on the hash, six standard deviations below what would give ``rows``: no sort, nothing comes to the driver.
    """
    n = df.count()
    if n <= rows:
        return df
    share = max(0.0, rows - 6 * math.sqrt(rows)) / n
    return df.where(F.shiftrightunsigned(F.xxhash64(key), 1) < F.lit(int(share * (1 << 63))))


def tidy() -> None:
    """Gives a worker's freed memory back at the end of a partition: workers live on, and what one stage held isn't the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows with the same value of a column, together; the input is sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        v = b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(v)) + 1).tolist(), len(v)]
        for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if held and (i or v[a] != held[-1].column(b.schema.get_field_index(column))[0].as_py()):
                yield pa.Table.from_batches(held)
                held = []
            if z > a:
                held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def tidied(rows: Callable) -> Callable:
    """A partition's function that gives its memory back at the end."""

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch], *more) -> Iterator[pa.RecordBatch]:
        yield from rows(batches, *more)
        tidy()

    return run


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a bucket of gapless ranks, about, at least.
BUCKET_ROWS = 250

#: md5 as a number of 60 bits: the same in every engine that has md5.
HASH_BITS = 60


def md5_60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def gapless_rank(df: DataFrame, group: str, sizes: dict, spread: str, order: Sequence[str], rank: str, per_bucket: int | None = None) -> DataFrame:
    """df with a column ``rank``: 0, 1, ... in each group without gaps, by ``spread`` and then ``order``.

    ``spread`` is a hash of 60 bits over the whole row, ``sizes`` the rows of each group (a few, known
    groups). The hash's top bits cut each group into buckets of about ``per_bucket`` rows, so no task
    holds a large group whole: ranks within a bucket come from a window, the buckets' starts from a
    running sum over bucket counts. By default a group has about as many buckets as a bucket has rows,
    the square root of its size, but none of under BUCKET_ROWS. Rows that are equal in every column are first counted, then spread
    out again, so that they can't fill a bucket either.
    """
    n, bucket, start = fresh(df, "n_equal"), fresh(df, "bucket"), fresh(df, "start")
    rows = lambda v: per_bucket or max(BUCKET_ROWS, math.sqrt(v))
    bits = {k: b for k, v in sizes.items() if (b := math.ceil(math.log2(v / rows(v)) if v > rows(v) else 0))}
    shift = F.lit(HASH_BITS)
    if bits:
        by_group = F.create_map(*[x for k, b in bits.items() for x in (F.lit(k), F.lit(HASH_BITS - b))])
        shift = F.coalesce(F.try_element_at(by_group, F.col(group).cast(df.schema[group].dataType)), shift)
    once = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(n)).withColumn(bucket, F.call_function("shiftright", F.col(spread), shift))
    keys = [group, bucket]
    counts = once.groupBy(*keys).agg(F.sum(n).alias(start))
    running = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(start, F.coalesce(F.sum(start).over(running), F.lit(0)))
    inside = Window.partitionBy(*keys).orderBy(spread, *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = once.withColumn(rank, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return (
        ranked.join(starts, keys)
        .withColumn(rank, F.col(rank) + F.col(start))
        .withColumn(rank, F.explode(F.sequence(F.col(rank), F.col(rank) + F.col(n) - 1)))
        .select(*df.columns, F.col(rank).cast("long").alias(rank))
    )
