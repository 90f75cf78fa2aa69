import gzip
import hashlib
import os

from fathom.llm import warc

BIG = "<p>é line\r\n\r\nWARC/1.0\nnext</p>\n" * 60
PAGES = [
    (1, "http://a", BIG), (2, "http://b", BIG), (9, None, BIG), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", ""), (6, "bad\r\nurl", None),
    (7, "http://f", "x" * 999), (8, "http://g", "x" * 999), (10, "http://h", "y" * 1000), (11, "http://i", "y" * 1000), (11, "http://i", "y" * 1000), (None, "http://n", "z" * 2000), (-1, "http://m", "z" * 2000),
    (12, "u", "no line end" * 300_000), (13, "u", "\n" * 3000), (14, "u", "ends with newline\n" * 70),
]


def expected(pages):
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        same = [j for j, _, g in pages if (g or "") == (h or "") and j is not None]
        top = max(same, default=None)
        again = len(data) >= 1000 and top is not None and (i is None or i < top)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def frame(spark, pages):
    return spark.createDataFrame([(i, u, h, "x", True) for i, u, h in pages], "page_id long, url string, html string, digest string, last boolean")


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    out = warc.archive_pages(frame(spark, PAGES), path)
    assert sorted((tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected(PAGES)
    chunks = warc.read_chunks(spark, path).collect()
    whole = {}
    for c in sorted((c for c in chunks if c.record_type == "response" and c.page_id is not None), key=lambda c: (c.page_id, c.chunk_no)):
        assert len(c.chunk) <= warc.CHUNK
        whole[c.page_id] = whole.get(c.page_id, b"") + bytes(c.chunk) if c.page_id != 11 else bytes(c.chunk)
    texts = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(texts[i] == w for i, w in whole.items()) and len([c for c in chunks if c.page_id == 12]) == 4
    files = [f for f in os.listdir(path) if f.startswith("part")]
    data = b"".join(gzip.open(os.path.join(path, f)).read() for f in files)
    assert data.count(b"WARC-Type: response\r\n") + data.count(b"WARC-Type: revisit\r\n") >= len(PAGES)
    assert b"bad  url" in data and data.endswith(b"\r\n\r\n")


def test_empty(spark):
    assert warc.archive_pages(frame(spark, [])).count() == 0


def test_no_text_is_longer_than_a_chunk(spark, tmp_path):
    """A payload of many chunks without a line end is written and read in parts; each part is a record of its own."""
    huge = "".join(chr(97 + k % 23) for k in range(1000)) * 5000 + "é"
    pages = [(1, "u", huge), (2, "v", huge), (3, "w", huge[: 1 << 20]), (4, "w", huge[: (1 << 20) + 1])]
    plan = warc.plan_records(frame(spark, pages))
    assert max(len(r.value.encode()) for r in warc.record_text(plan).collect()) < warc.CHUNK + 2000
    path = str(tmp_path / "w")
    assert sorted(tuple(r) for r in warc.archive_pages(frame(spark, pages), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == expected(pages)
    chunks = warc.read_chunks(spark, path).where("record_type = 'response'").collect()
    for i, n in ((2, 5), (3, 1), (4, 2)):
        own = sorted((c for c in chunks if c.page_id == i), key=lambda c: c.chunk_no)
        assert [c.chunk_no for c in own] == list(range(n)) and b"".join(bytes(c.chunk) for c in own) == dict((k, h) for k, _, h in pages)[i].encode()
    lines = [x for f in os.listdir(path) if f.startswith("part") for x in gzip.open(os.path.join(path, f)).read().split(b"\n")]
    assert max(map(len, lines)) < warc.CHUNK + 2000
    assert sum(x.startswith(b"WARC-Type: continuation") for x in lines) == 5 and sum(x.startswith(b"WARC-Segment-Total-Length") for x in lines) == 2


def test_small_chunks(spark, tmp_path):
    plan = warc.plan_records(frame(spark, PAGES))
    path = str(tmp_path / "w")
    warc.record_text(plan, 700).write.option("lineSep", "\n").option("compression", "gzip").text(path)
    out = warc.records(warc.read_chunks(spark, path)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == expected(PAGES)


def test_revisits_beyond_a_broadcast(spark):
    some = lambda df: sorted(((r.page_id, r.url, r.payload and bytes(r.payload), r.digest, r.n, r.refers_to) for r in df.collect()), key=repr)
    assert some(warc.plan_records(frame(spark, PAGES), broadcast_rows=0)) == some(warc.plan_records(frame(spark, PAGES)))


def test_payloads_are_not_shuffled(spark, small):
    plan = warc.plan_records(spark.read.parquet(f"{small}/pages.parquet"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
