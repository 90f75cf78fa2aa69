"""WARC archives of page records, written by Spark and read back as chunk rows with running digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import scratch_path, written

#: Payloads under this are always stored in full.
LEAST_SHARED = 1000

#: Bytes of a payload in one chunk row and in one record of an archive, at most: a longer payload goes on in continuation records.
CHUNK = 1 << 20

#: Revisits, a few numbers each, that are broadcast; beyond, pages that may be copies are shuffled, told by bitmaps of up to MOST_BITS.
BROADCAST_ROWS, MOST_BITS = 200_000, 1 << 27

WARC_DATE = "2024-01-01T00:00:00Z"  # fixed value: archives are the same however often they are written


def _pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    return rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"))


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_SHARED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per page: page_id, url, payload (null for a revisit), digest, n, refers_to (null: a response).

    Of equal payloads (SHA-1 and length) of at least ``least`` bytes, the largest page_id is the
    response; rows that repeat that page_id are responses too. What is decided is decided on ids,
    digests and lengths alone, counted before their shuffle, so a payload that a third of the pages
    share is one row a task. Payloads stay where they are: the revisits meet them by a broadcast, whose size is checked; beyond it
    only rows that a bitmap of the revisits lets through are shuffled. A null payload is empty; a null page_id
    is smaller than any.
    """
    rows = _pages(pages, key, url, html)
    slim = written(rows.select("page_id", "digest", "n").where(F.col("n") >= least), "digests")
    held = written(slim.groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "shared")
    copies = slim.join(held, ["digest", "n"]).where("page_id is null or page_id < top").groupBy("page_id", "digest", "n").agg(F.max("top").alias("refers_to"))
    copies = written(copies, "revisits")
    many = copies.count()
    out = lambda df: df.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "n", "refers_to")
    if many <= broadcast_rows:
        return out(_meet(rows, F.broadcast(copies)))
    bit = _bit_of(min(MOST_BITS, 1 << (16 * many - 1).bit_length()))
    bitmaps = copies.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))
    marked = rows.withColumn("bit", bit).withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(bitmaps), "bucket", "left")
    place = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bitmap", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn("may", F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))).drop("bit", "bucket", "bitmap")
    alone = marked.where("not may").drop("may").withColumn("refers_to", F.lit(None).cast("long"))
    return out(alone).unionByName(out(_meet(marked.where("may").drop("may"), copies)))


def _bit_of(bits: int) -> Column:
    return F.pmod(F.xxhash64("page_id", "digest", "n"), F.lit(bits))


def _meet(rows: DataFrame, copies: DataFrame) -> DataFrame:
    right = copies.select(F.col("page_id").alias("c_id"), F.col("digest").alias("c_digest"), F.col("n").alias("c_n"), "refers_to")
    return rows.join(right, (F.col("digest") == F.col("c_digest")) & (F.col("n") == F.col("c_n")) & F.col("page_id").eqNullSafe(F.col("c_id")), "left").drop("c_id", "c_digest", "c_n")


def _header(value: Column | str) -> Column:
    """A value that can't end its header line."""
    return F.regexp_replace(value, "[\r\n]", " ")


def record_text(plan: DataFrame, chunk: int | None = None) -> DataFrame:
    """One column, value: the WARC text of each record without the last byte of its end, which the writer adds.

    A payload of more than ``chunk`` bytes goes on in continuation records of as much each, right
    after the first and numbered by WARC-Segment-Number, so no text is longer than a chunk and its header.
    """
    chunk = chunk or CHUNK
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    again, first = F.col("refers_to").isNotNull(), F.col("part") == 0
    parts = F.when(again, F.lit(1)).otherwise(F.greatest(F.ceil(F.col("n") / chunk), F.lit(1))).cast("int")
    cut = plan.select("page_id", "url", "digest", "n", "refers_to", "payload", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    data = F.coalesce(F.when(F.col("parts") == 1, F.col("payload")).otherwise(F.substring("payload", F.col("part") * chunk + 1, F.lit(chunk))), F.lit(b"")).cast("string")
    size = F.when(again, F.lit(0)).otherwise(F.least(F.lit(chunk), F.col("n") - F.col("part") * chunk)) + F.when(first, F.octet_length(http)).otherwise(F.lit(0))
    last = (F.col("parts") > 1) & (F.col("part") == F.col("parts") - 1)
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(~first, "continuation").when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.when(first, name(F.col("page_id"))).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), (F.col("part") + 1).cast("string"), F.lit(">")))),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: "), name(F.col("page_id")))),
        F.when(F.col("parts") > 1, F.concat(F.lit("WARC-Segment-Number: "), (F.col("part") + 1).cast("string"))),
        F.when(last, F.concat(F.lit("WARC-Segment-Total-Length: "), (F.col("n") + F.octet_length(http)).cast("string"))),
        F.lit(f"WARC-Date: {WARC_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _header("url")),  # null: no such line
        F.when(first, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(first, F.lit("Content-Type: application/http; msgtype=response")),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    return cut.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.when(first, http).otherwise(F.lit("")), data, F.lit("\r\n\r")).alias("value"))


def write_archives(plan: DataFrame, path: str) -> None:
    """WARC files under path, one a task, by Spark's own writer, so path may be in any store.

    Null pages are empty responses, repeated rows records each, and an empty table gives no record.
    Files are compressed, thus one reader takes a file from its start to its end, and a record's
    continuations follow it in its file.
    """
    record_text(plan).write.option("lineSep", "\n").option("compression", "gzip").text(path)


CHUNKS = "page_id long, url string, record_type string, refers_to long, declared string, chunk_no long, chunk binary, last boolean, payload_bytes long, payload_digest string"


class Reader:
    """Follows the lines of archives; gives chunk rows as their bytes come, never a whole record."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.state, self.head, self.head_of = "between", {}, None

    def begin(self) -> None:
        h = self.head
        self.left = int(h["content-length"])
        more = h["warc-type"] == "continuation"
        if more:
            if self.head_of is None or h.get("warc-segment-origin-id") != self.head_of.get("warc-record-id") or int(h["warc-segment-number"]) != self.segment + 1:
                raise ValueError("a continuation doesn't follow its record")
            self.segment += 1
        else:
            if self.head_of is not None:
                raise ValueError("a record lacks its continuations")
            self.head_of, self.segment = h, 1
            self.digest, self.size, self.number, self.buffer, self.held = hashlib.sha1(), 0, 0, [], 0
        self.open = "warc-segment-number" in h and "warc-segment-total-length" not in h
        self.state = "payload" if more else "http"
        if not self.left:
            self.end()

    def end(self) -> None:
        """The end of a record; of its payload, unless a continuation follows."""
        self.state = "between"
        if not self.open:
            self.flush(True)
            self.head_of = None

    def flush(self, last: bool) -> None:
        page = lambda x: None if x is None or (n := x[10:-1]) == "null" else int(n)
        h = self.head_of
        self.rows.append((page(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], page(h.get("warc-refers-to")), (h.get("warc-payload-digest") or "").removeprefix("sha1:"), self.number, b"".join(self.buffer), last, self.size if last else None, self.digest.hexdigest() if last else None))
        self.number += 1
        self.buffer, self.held = [], 0

    def payload(self, data: bytes) -> None:
        self.digest.update(data)
        self.size += len(data)
        for i in range(0, len(data), CHUNK):
            part = data[i : i + CHUNK]
            if self.held and self.held + len(part) > CHUNK:
                self.flush(False)
            self.buffer.append(part)
            self.held += len(part)

    def line(self, line: bytes) -> None:
        """One line, without its last byte, the line feed."""
        if self.state == "between":
            if line.startswith(b"WARC/"):
                self.state, self.head = "head", {}
        elif self.state == "head":
            if line == b"\r":
                self.begin()
            else:
                name, _, value = line.decode().partition(":")
                self.head[name.lower()] = value.strip()
        else:
            data = line + b"\n"
            mine = data[: self.left]
            self.left -= len(mine)
            if self.state == "payload":
                self.payload(mine)
            elif line == b"\r":
                self.state = "payload"
            if not self.left:
                self.end()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under path: a row for each chunk of a record, in order; the last one
    carries the payload's size and SHA-1, both kept up while the bytes came by."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            for x in b.column(0).to_pylist():
                reader.line(x)
                if len(reader.rows) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*reader.rows, strict=True), kinds, strict=True)], schema=kinds)
                    reader.rows = []
        if reader.state != "between" or reader.head_of is not None:
            raise ValueError("an archive ends within a record")
        if reader.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*reader.rows, strict=True), kinds, strict=True)], schema=kinds)

    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(rows, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, from a table of its chunks, or of the last ones.

    A revisit takes size and digest of the response that it refers to and whose payload has the
    digest that it declares; without one, they are null.
    """
    ends = chunks.where("last")
    response = ends.where("record_type = 'response'")
    full = response.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = ends.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(full, ["refers_to", "declared"], "left").withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("declared")))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return response.select(*out).unionByName(again.select(*out))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages as archives (path: where; else in the shared folder) and reads them back; see records().

    Empty tables write empty archives. Columns other than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(plan_records(pages), path)
    return records(written(read_chunks(spark, path).where("last").drop("chunk"), "warc-records"))


#: DuckDB: the same rows as op6_warc.
SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM g
"""
