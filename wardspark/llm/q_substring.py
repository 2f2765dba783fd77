"""op12: every repeated passage of 20 words removed from all documents."""

from __future__ import annotations

from wardspark.llm import substring
from wardspark.llm.common import table


def op12_substring_dedup(spark, sf_dir):
    return substring.repeats_removed(table(spark, sf_dir, "documents"), texts=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op12_substring_dedup": op12_substring_dedup}
ORACLES = {"op12_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, p) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r WHERE n > 1),
gone AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
         list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '), ''))
         AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id IS NOT DISTINCT FROM d.doc_id"""}
