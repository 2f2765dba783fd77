"""op11: the trie of all conversations, rebuilt so that five neighbours share their beginnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.llm import prefixtrie
from wardspark.llm.common import table


def op11_prefix_trie(spark, sf_dir):
    turns = prefixtrie.ordered_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    return prefixtrie.trie(prefixtrie.with_shared_heads(
        turns, conv - conv % 5, F.crc32(conv.cast("string")) % 9))


# CRC-32 bit by bit: each character is followed by seven steps without one
_CRC = ("(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), "
        "lambda x: [CAST(unicode(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: "
        "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295))")
ORACLES = {"op11_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations
           WHERE conv_id IS NOT NULL),
o AS (SELECT c, [role, text] AS x, strlen(text) AS b, CAST(c - c % 5 AS BIGINT) AS base,
             row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM t),
k AS (SELECT DISTINCT c, base, {_CRC} % 9 AS h FROM o),
f AS (SELECT k.c, 0 AS part, o.i, o.x, o.b FROM k JOIN o ON o.c = k.base AND o.i < k.h
      UNION ALL SELECT k.c, 1, o.i, o.x, o.b FROM k JOIN o ON o.c = k.c AND o.i >= k.h),
p AS (SELECT k.c, coalesce(list(x ORDER BY part, i) FILTER (WHERE x IS NOT NULL), []) AS s,
             coalesce(list(b ORDER BY part, i) FILTER (WHERE x IS NOT NULL), []) AS b
      FROM k LEFT JOIN f USING (c) GROUP BY k.c),
a AS (SELECT c, d, len(s) AS l, sha256(CAST(s[1:d] AS VARCHAR) || d) AS node,
             CASE WHEN d > 0 THEN sha256(CAST(s[1:d - 1] AS VARCHAR) || (d - 1)) END AS parent,
             CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes
      FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM p)),
n AS (SELECT node, any_value(parent) AS parent, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs,
             any_value(bytes) AS bytes,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE l = d), '')) AS ends_sha256
      FROM a GROUP BY node),
ch AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
-- every node with each node above it, found along the path of its least member
u AS (SELECT up.node AS top, n.node FROM n JOIN a up ON up.c = n.conv_id AND up.d <= n.depth),
s AS (SELECT top, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (WHERE ch.node IS NULL) AS leaves
      FROM u JOIN n ON n.node = u.node LEFT JOIN ch ON ch.node = u.node GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(ch.n_children, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.top = n.node LEFT JOIN ch ON ch.node = n.node LEFT JOIN n q ON q.node = n.parent"""}
QUERIES = {"op11_prefix_trie": op11_prefix_trie}
