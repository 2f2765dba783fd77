import base64
import gzip
import hashlib
import io
import random

import pyarrow as pa
from pyspark.sql import functions as F

from wardspark.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS payload", "'y' AS sha", "1 AS refers_to")


def expected(rows, min_revisit=0):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max([x for x in (top.get(h or ""), i) if x is not None], default=None)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = top[h or ""]
        later = len(raw) >= min_revisit and first is not None and (i is None or i < first)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if later else "response", first if later else None))
    return sorted(out, key=str)


def read(spark, rows, split=4 << 20, **options):
    manifest = warc.archive(pages(spark, rows).drop("payload", "sha", "refers_to"), **options)
    return manifest, sorted((tuple(r) for r in warc.read_archives(manifest, split, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def rows_of(n):
    r = random.Random(0)
    noise = bytes(r.randrange(256) for _ in range(300)).decode("latin-1")
    return [(i, f"http://h/{i}\r\n", f"<p>{i % 7} é {noise * (i % 5)}\x1f\x8b\x08</p>" if i % 11 else None)
            for i in range(n)]


def test_round_trip_whatever_the_split(spark):
    rows = rows_of(120)
    for split in (1, 37, 1000, 1 << 20):
        assert read(spark, rows if split > 1 else rows[:9], split)[1] == expected(rows if split > 1 else rows[:9])


def test_archives_are_valid_gzip_members_and_payloads_whole(spark):
    rows = rows_of(50)
    manifest, _ = read(spark, rows)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(manifest).where(
        "record_type = 'response'").collect()}
    want = {i: (h or "").encode() for i, _, h in rows}
    assert got and all(want[i] == p for i, p in got.items())
    plain = b"".join(gzip.open(r["path"].removeprefix("file:")).read() for r in manifest.collect())
    assert plain.count(b"WARC/1.1\r\n") == 50


def test_odd_pages(spark):
    rows = [(1, None, None), (2, None, ""), (2, "u", ""), (None, "u", "a"), (3, "u", "a"), (4, "u", "é" * 300000),
            (None, None, "only null")]
    assert read(spark, rows, 1000)[1] == expected(rows)
    assert read(spark, rows, min_revisit=1)[1] == expected(rows, 1)
    assert read(spark, [])[1] == []


def test_magic_inside_a_member_is_no_record():
    inner = gzip.compress(b"not a record")
    stored = warc.record(1, "u", b"a" * 10, None, "t")
    # a stored block keeps the inner member's bytes as they are
    import zlib
    plain = gzip.decompress(warc.record(2, "u", inner + inner, None, "t"))
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = stored + z.compress(plain) + z.flush() + stored
    assert data.count(warc.MAGIC) == 5
    for block in (64, 1 << 20):
        found = list(warc.records_in(warc._Source(io.BytesIO(data), len(data), block), 0, len(data)))
        assert [f["warc-record-id"] for _, f, _ in found] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:1>"]
        assert found[1][2] == inner + inner
    for cut in range(1, len(data)):  # every record is owned by one range
        starts = [s for lo, hi in ((0, cut), (cut, len(data))) for s, _, _ in warc.records_in(
            warc._Source(io.BytesIO(data), len(data)), lo, hi)]
        assert len([s for s in starts if s in (0, len(stored), len(data) - len(stored))]) == 3


def test_headers_of_any_length_are_read_back(spark, tmp_path):
    import random
    r = random.Random(0)
    long_url = "http://x/" + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(2_200_000))
    rows = [(1, long_url, "<p>one</p>"), (2, "u", "<p>two</p>"), (3, "http://y/" + "z" * 3_000_000, "<p>one</p>"), (4, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.sparkContext.setCheckpointDir(str(tmp_path)) if spark.sparkContext.getCheckpointDir() is None else None
    manifest = warc.archive(df)
    for split in (1 << 16, 4 << 20):
        got = {x["page_id"]: x for x in warc.read_archives(manifest, split=split).collect()}
        assert {k: (v["uri"], v["record_type"], v["refers_to"]) for k, v in got.items()} == {
            1: (long_url, "revisit", 3), 2: ("u", "response", None), 3: (rows[2][1], "response", None), 4: (None, "response", None)}
