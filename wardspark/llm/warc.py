"""WARC archives: one gzip member per record, written once and read back by splittable byte ranges.

Writing: each task writes one archive into a shared folder, under a name of its own, and renames it when complete;
the manifest (path, bytes) is kept as a table, so an archive of a task that died is never read. Of records with
equal payloads the one with the largest page id is the response; the others are revisits that name it and its digest,
without the payload.

Reading: archives are cut into ranges of ``split`` bytes, whatever their records. A task scans its range for the gzip
magic. A hit may be compressed data that looks like one, so the task inflates the beginning and takes the hit as a
record only if a WARC version line and a header, of any length, follow. A record belongs to the range in which its first byte lies; its
member is read to its end, beyond the range if need be.

Defined cases: a null payload is empty; a payload of fewer than ``min_revisit`` bytes is never a revisit. A page id
given more than once has one record per row; among equal payloads the rows with the largest id are all responses. A
null page id stays null and is smaller than any other. Empty tables give no archive and no rows. Payloads of any size
are kept whole; a task holds one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import map_batches
from wardspark.session import checkpoint_dir, materialize

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Tasks of one read; beyond this a task has several ranges.
MOST_TASKS = 50_000
RECORD_FIELDS = ("page_id long, uri string, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, archive string, start long, payload binary")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; the scheme decides, as for Spark's own readers."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_originals(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
                   url_col: str | None = "url", min_revisit: int = 0) -> DataFrame:
    """(page_id, uri, payload, refers_to): the page that a revisit refers to, null for a response."""
    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.cast("string").alias("uri"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload"))
    shared = (keyed.where(F.length("payload") >= min_revisit).groupBy("sha")
              .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    joined = keyed.join(shared, "sha", "left")
    later = F.col("original").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("original")))
    return joined.select("page_id", "uri", "payload", F.when(later, F.col("original")).alias("refers_to"))


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, when: str) -> bytes:
    """One gzip member that holds one WARC record."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    clean = (uri or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Date: {when}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
             f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
             f"Content-Length: {len(body)}"]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    plain = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


def write_archives(rows: DataFrame, folder: str, date: datetime = datetime(2000, 1, 1, tzinfo=UTC)) -> DataFrame:
    """Write (page_id, uri, payload, refers_to) rows; the manifest (path, bytes, records) of the archives written."""
    when = date.strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        store, base = open_store(folder)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, size, count = None, 0, 0
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "uri", "payload", "refers_to")]
            for i in range(b.num_rows):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(name + ".tmp", compression=None)
                member = record(*(c[i].as_py() for c in cols), when)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            store.move(name + ".tmp", name)
            scheme = folder.split(":", 1)[0] if ":" in folder else "file"
            where = name if scheme == "file" else f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([size]), pa.array([count])],
                                             ["path", "bytes", "records"])

    return materialize(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def ranges(manifest: DataFrame, split: int) -> DataFrame:
    """(path, bytes, lo, hi): every archive cut into ranges of ``split`` bytes."""
    cut = manifest.select("path", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("lo"))
    return cut.withColumn("hi", F.least(F.col("lo") + split, F.col("bytes")))


class _Source:
    """Bytes of an archive by position, read in blocks."""

    def __init__(self, file, size: int, block: int = 1 << 20):
        self.file, self.size, self.block = file, size, block
        self.at, self.data = 0, b""

    def read(self, at: int) -> bytes:
        """Some bytes from ``at`` on; empty at the end."""
        if at >= self.size:
            return b""
        if not self.at <= at < self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(min(self.block, self.size - at))
        return self.data[at - self.at:]


def _header(source: _Source, at: int) -> dict[str, str] | None:
    """Fields of the record whose member begins at ``at``; None if no record does."""
    z, plain, end = zlib.decompressobj(31), bytearray(), -1
    try:
        while end < 0:
            chunk = z.unconsumed_tail or source.read(at)
            if not chunk or z.eof:
                return None
            if not z.unconsumed_tail:
                chunk = chunk[:4096]
                at += len(chunk)
            seen = max(len(plain) - 3, 0)
            plain += z.decompress(chunk, 1 << 16)
            # compressed data that only looks like a member is told by its first bytes; a header may be of any length
            if not plain.startswith(VERSION[:len(plain)]):
                return None
            end = plain.find(b"\r\n\r\n", seen)
    except zlib.error:
        return None
    pairs = [x.split(": ", 1) for x in plain[len(VERSION):end].decode("utf-8", "replace").split("\r\n")]
    fields = {x[0].lower(): x[1] for x in pairs if len(x) == 2}
    return fields if {"warc-type", "warc-record-id", "content-length"} <= set(fields) else None


def _member(source: _Source, at: int) -> tuple[bytes, int]:
    """The whole member at ``at``, inflated, and where it ends."""
    z, parts = zlib.decompressobj(31), []
    while not z.eof:
        chunk = source.read(at)
        if not chunk:
            raise ValueError(f"a record is cut off at byte {at}")
        parts.append(z.decompress(chunk))
        at += len(chunk) - len(z.unused_data)
    return b"".join(parts), at


def records_in(source: _Source, lo: int, hi: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(start, fields, payload) of the records that begin in [lo, hi)."""
    at = lo
    while at < hi:
        window = source.read(at)
        hit = window.find(MAGIC)
        if hit < 0:  # the magic may lie across the end of this block
            step = max(len(window) - len(MAGIC) + 1, 1)
            if at + len(window) >= source.size:
                return
            at += step
            source.at, source.data = 0, b""
            continue
        at += hit
        if at >= hi:
            return
        fields = _header(source, at)
        if fields is None:
            at += 1
            continue
        plain, end = _member(source, at)
        body = plain.find(b"\r\n\r\n") + 4
        yield at, fields, plain[body:body + int(fields["content-length"])]
        at = end


def read_archives(manifest: DataFrame, split: int = 4 << 20, payloads: bool = True,
                  tasks: int | None = None) -> DataFrame:
    """The records of the archives in ``manifest``, in the columns of ``RECORD_FIELDS``; ``payload`` if asked for.

    The digest and length of a response are those of the payload as read, a revisit's those of its header.
    """
    names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "start",
             "payload"]
    # as many tasks as ranges: their rows are tiny, so left to itself adaptive execution would read all in one task
    n = tasks or min(manifest.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1, MOST_TASKS)
    cut = ranges(manifest, split).repartition(n, "path", "lo")

    def page(value: str | None) -> int | None:
        text = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def one(b):
        for p, size, lo, hi in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            store, path = open_store(p) if ":" in p.split("/", 1)[0] else (pafs.LocalFileSystem(), p)
            rows: list[tuple] = []
            held = 0
            with store.open_input_file(path) as file:
                for start, f, body in records_in(_Source(file, size), lo, hi):
                    own = f["warc-type"] == "response"
                    rows.append((page(f["warc-record-id"]), f.get("warc-target-uri") or None,
                                 len(body) if own else int(f["warc-payload-length"]),
                                 digest(body) if own else f["warc-payload-digest"].removeprefix("sha1:"),
                                 f["warc-type"], page(f.get("warc-refers-to")), p, start, body if payloads else None))
                    held += len(body) * payloads
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)

    return map_batches(cut.select("path", "bytes", "lo", "hi"), one, RECORD_FIELDS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(),
             pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names)


def archive(pages: DataFrame, name: str = "warc", **columns) -> DataFrame:
    """Write ``pages`` under the shared folder; the manifest."""
    folder = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    return write_archives(with_originals(pages, **columns), folder)
