"""op1: near-duplicate classes of all documents."""

from __future__ import annotations

from wardspark.llm import jaccard
from wardspark.llm.common import table


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_copies", "n_links")


# one row per document: its class by links of at least 0.8 on sets of five words, and the number of its links
CLASSES = """
w AS (SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
t AS (SELECT text, any_value(w) AS w, min(doc_id) AS least, count(*) AS n FROM w GROUP BY text),
g AS (SELECT DISTINCT least, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, chr(31))]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(31))) END) AS gram
      FROM t WHERE len(w) > 0),
z AS (SELECT least, count(*) AS size FROM g GROUP BY least),
p AS (SELECT a.least AS a, b.least AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.least <> b.least
      GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN z x ON x.least = p.a JOIN z y ON y.least = p.b
      WHERE shared / (x.size + y.size - shared) >= 0.8),
r AS (SELECT a AS id, a AS root FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.root),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
k AS (SELECT l.a AS id, CAST(sum(t.n) AS BIGINT) AS links FROM l JOIN t ON t.least = l.b GROUP BY 1),
classes AS (
  SELECT w.doc_id, CASE WHEN len(t.w) = 0 THEN w.doc_id ELSE coalesce(c.root, t.least) END AS class_id,
         CAST(t.n AS BIGINT) AS n_copies,
         CAST(CASE WHEN len(t.w) = 0 THEN 0 ELSE coalesce(k.links, 0) + t.n - 1 END AS BIGINT) AS n_links
  FROM w JOIN t ON t.text = w.text LEFT JOIN c ON c.id = t.least LEFT JOIN k ON k.id = t.least)"""
QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
ORACLES = {"op1_ngram_jaccard": f"WITH RECURSIVE {CLASSES} SELECT * FROM classes"}
