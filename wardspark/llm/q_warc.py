"""op8: every page through a WARC archive and back."""

from __future__ import annotations

from wardspark.llm import warc
from wardspark.llm.common import table


def op8_warc(spark, sf_dir):
    manifest = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# 5 bits at a time of the digest's 160, from its hexadecimal digits
_DIGEST = (f"array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + "
           "((CAST('0x' || substr(h, (i * 5) // 4 + 1, 2) AS INTEGER) >> (3 - (i * 5) % 4)) & 31), 1)), '')")
ORACLES = {"op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT h, max(page_id) AS original FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to
FROM p JOIN b USING (h)"""}
QUERIES = {"op8_warc": op8_warc}
