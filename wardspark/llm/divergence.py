"""Audit of how the sources of a language differ in their words, over K-squared quadtrees of the group-term matrix.

Terms are runs of ASCII letters and non-ASCII characters, A to Z in lower case. A language keeps the V terms that occur
in at least ``least`` of its documents. A group (language, source), and the language itself, gives a kept term with
``count`` occurrences there the weight p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the group's sum over kept terms.
Two weights differ by f = floor((p - q)^2 / (p + q)); two sources by the sum of f over all V terms.

A language's matrix of counts, groups by terms, is cut into stripes of ``stripe`` terms and blocks of ``side`` groups. A
task holds one stripe of two blocks, each a forest of K-squared quadtrees (K = 2) over squares of ``side``: a node has a bit
per quadrant that is not all zero, children are found by rank, leaves are tiles of 8 x 8 weights. The two are traversed
together. Where the quadrants of both are zero, every pair of their groups has the same f for each term: such terms are
not visited, and the closing sum prices all terms that a pair's traversal left out as their number times f of the two
weights of count 0. Tiles that are reached are summed exactly in 64-bit integers.

Scale: documents are read once. Counts are added up per chunk in the task, then by partial aggregation, so a hot source
or a frequent term is a row per task. A task of the traversal holds at most two blocks of one stripe, whatever the
number of documents; its cells are sent to each block pair of the language. The pair part has a row per ordered pair of
a language's sources, as asked for. The ten first terms of a group are limited in each task before the shuffle.

Exact: weights are computed in decimals of 38 digits, all sums in 64-bit integers, which hold them up to 10^18 terms.

Defined cases: null text, language or source is empty. Repeated rows count as documents of their own. A group without
terms has N = 0; where V is 0 all differences are 0 and there are no terms. A language with one source has no pairs. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm import bytesx
from wardspark.llm.common import SLICE_BYTES, map_batches
from wardspark.session import materialize

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Groups and terms of a leaf of the trees.
LEAF = 8


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lens = ends - starts
    off = np.concatenate([[0], np.cumsum(lens)])
    at = np.repeat(starts - off[:-1], lens) + np.arange(off[-1])
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(off), pa.py_buffer(data[at].tobytes()))


def _counts(data: np.ndarray, off: np.ndarray, group: np.ndarray):
    """Per group and term of a slice: group, hash, occurrences, documents and the term."""
    data = _LOWER[data]
    starts, ends = bytesx.runs(bytesx.LETTER[data], off)
    h = bytesx.span_hashes(data, starts, ends)
    row = bytesx.rows_of(starts, off)
    g = group[row]
    order = np.lexsort((row, h, g))
    h, g, row = h[order], g[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    doc = new.copy()
    doc[1:] |= row[1:] != row[:-1]
    if not len(first):
        return g, h, first, first, pa.array([], pa.large_string())
    n = np.diff(np.append(first, len(h)))
    at = order[first]
    return g[first], h[first], n, np.add.reduceat(doc.astype(np.int64), first), _strings(data, starts[at], ends[at])


def _merged(parts: list):
    """Joined results of ``_counts``, equal groups and terms added up."""
    g, h, n, df = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:4])
    term = pa.concat_arrays([p[4] for p in parts])
    order = np.lexsort((h, g))
    g, h = g[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return g, h, n, df, term
    return (g[first], h[first], np.add.reduceat(n[order], first), np.add.reduceat(df[order], first),
            term.take(pa.array(order[first])))


def term_counts(docs: DataFrame, chunk: int = 300_000) -> DataFrame:
    """(lang, source, term, n, df) of (lang, source, text) rows: occurrences and documents of each term in each group."""
    def one(b):
        lang, source = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
        width = len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
        data, off = bytesx.column_bytes(b.column(2))
        held, size = [], 0

        def flush():
            g, _, n, df, term = _merged(held)
            return pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // width)), source.dictionary.take(pa.array(g % width)),
                 term.cast(pa.string()), pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])

        for lo, hi in bytesx.slices(off, SLICE_BYTES):
            held.append(_counts(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], group[lo:hi]))
            size += len(held[-1][0])
            if size > chunk:  # what merging leaves is held on while it is few
                held = [_merged(held)]
                size = len(held[0][0])
                if size > chunk // 2:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    found = map_batches(docs.select("lang", "source", "text"), one, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def weight(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exact; null where nothing is kept."""
    d = "decimal(20,0)"
    parts = F.named_struct(F.lit("c"), (count + 2).cast(d), F.lit("m"), (total + kept * 2).cast(d))
    # integral division of decimals has no function of its own
    whole = F.call_function("div", parts["c"] * F.lit(1_000_000_000).cast("decimal(10,0)"), parts["m"])
    return F.when(kept > 0, whole + 1)


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of long columns."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class K2Forest:
    """K-squared quadtrees over the squares of a matrix of ``side`` rows, side by side."""

    def __init__(self, side: int, row: np.ndarray, col: np.ndarray, value: np.ndarray, zero: np.ndarray, n_cols: int):
        """Cells (row, col, value) that are not zero; ``zero``: what a zero of each row counts as."""
        self.side, self.zero, self.n_cols = side, zero, n_cols
        self.depth = (side // LEAF).bit_length() - 1
        path, shift = col // side, side.bit_length() - 1
        nodes = np.unique(path)
        self.roots = np.full(-(-n_cols // side), -1)
        self.roots[nodes] = np.arange(len(nodes))
        self.bits, self.rank = [], []
        for level in range(1, self.depth + 1):
            path = path * 4 + ((row >> (shift - level)) & 1) * 2 + ((col >> (shift - level)) & 1)
            below = np.unique(path)
            bits = np.zeros(4 * len(nodes), bool)
            bits[np.searchsorted(nodes, below // 4) * 4 + below % 4] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits))
            nodes = below
        leaf = np.searchsorted(nodes, path)
        self.tiles = np.empty((len(nodes), LEAF, LEAF), np.int64)
        tile_row = np.zeros(len(nodes), np.int64)
        tile_row[leaf] = row // LEAF
        self.tiles[:] = zero.reshape(-1, LEAF)[tile_row][:, :, None]
        self.tiles[leaf, row % LEAF, col % LEAF] = value

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The child of each node, -1 if that quadrant, or the node, is all zero."""
        at = node * 4 + quadrant
        some = node >= 0
        some[some] = self.bits[level][at[some]]
        out = np.full(len(node), -1)
        out[some] = self.rank[level][at[some]] - 1
        return out

    def leaves(self, node: np.ndarray, tile_row: np.ndarray) -> np.ndarray:
        """Tiles of leaf nodes; an all-zero one from the zeros of its rows."""
        out = np.repeat(self.zero.reshape(-1, LEAF)[tile_row][:, :, None], LEAF, 2)
        out[node >= 0] = self.tiles[node[node >= 0]]
        return out


def joint_differences(a: K2Forest, b: K2Forest, own: bool, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(sums, terms): per pair of a row of ``a`` and one of ``b`` the difference over the terms that were visited, and
    their number. With ``own`` the two are one, and only pairs in ascending order are complete."""
    tiles = a.side // LEAF
    sums = np.zeros((tiles, tiles, LEAF, LEAF), np.int64)
    terms = np.zeros((tiles, tiles), np.int64)
    col = np.flatnonzero((a.roots >= 0) | (b.roots >= 0))
    na, nb = a.roots[col], b.roots[col]
    ra, rb = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
    for level in range(a.depth):
        parts = []
        for i in range(8):
            x, y, c = i >> 2, (i >> 1) & 1, i & 1
            two = a.child(level, na, np.int64(x * 2 + c)), b.child(level, nb, np.int64(y * 2 + c))
            keep = (two[0] >= 0) | (two[1] >= 0)
            if own:
                keep &= ra * 2 + x <= rb * 2 + y
            parts.append([v[keep] for v in (*two, ra * 2 + x, rb * 2 + y, col * 2 + c)])
        na, nb, ra, rb, col = (np.concatenate(v) for v in zip(*parts, strict=True))
    for lo in range(0, len(col), step):
        s = slice(lo, lo + step)
        inside = np.clip(a.n_cols - col[s] * LEAF, 0, LEAF)
        p, q = a.leaves(na[s], ra[s])[:, :, None, :], b.leaves(nb[s], rb[s])[:, None, :, :]
        d = p - q
        f = d * d // (p + q)
        f *= (np.arange(LEAF) < inside[:, None])[:, None, None, :]
        np.add.at(sums, (ra[s], rb[s]), f.sum(3))
        np.add.at(terms, (ra[s], rb[s]), inside)
    return sums.transpose(0, 2, 1, 3).reshape(a.side, a.side), np.repeat(np.repeat(terms, LEAF, 0), LEAF, 1)


def _traverse(t: pa.Table, side: int) -> pa.Table:
    """One stripe of two blocks of groups: sums and visited terms of their pairs."""
    t = t.combine_chunks()
    x, y = t["x"][0].as_py(), t["y"][0].as_py()
    block, g, p = (t[c].to_numpy() for c in ("block", "g", "p"))
    term = t["term"].combine_chunks()
    cell = term.is_valid().to_numpy(zero_copy_only=False)
    code = term.dictionary_encode().indices.fill_null(0).to_numpy().astype(np.int64)
    n_cols = int(code[cell].max(initial=-1)) + 1
    # terms that the same groups hold lie side by side
    held = np.bincount(code[cell], minlength=n_cols)
    least = np.full(n_cols, np.iinfo(np.int64).max)
    np.minimum.at(least, code[cell], block[cell] * side + g[cell])
    place = np.empty(n_cols, np.int64)
    place[np.lexsort((least, held))] = np.arange(n_cols)
    forests, counts = [], []
    for which in (x, y):
        mine = block == which
        zero = np.ones(side, np.int64)
        zero[g[mine & ~cell]] = p[mine & ~cell]
        counts.append(int(g[mine & ~cell].max()) + 1)
        at = mine & cell
        forests.append(K2Forest(side, g[at], place[code[at]], p[at], zero, n_cols))
    sums, terms = joint_differences(*forests, x == y)
    i, j = (v.ravel() for v in np.indices((counts[0], counts[1])))
    use = terms[i, j] > 0
    if x == y:
        use &= i < j
    i, j = i[use], j[use]
    return pa.table({"lang": pa.repeat(t["lang"][0], len(i)), "a": i + x * side, "b": j + y * side, "sum": sums[i, j],
                     "terms": terms[i, j]})


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10,
          top: int = 10, stripe: int = 8192, side: int = 256) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, how each other source of the language differs, and part
    ``term``, the ``top`` terms that the group has more of than its language.

    ``side``: a power of two, 8 at least.
    """
    docs = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = materialize(term_counts(docs), "audit-counts")
    kept = materialize(counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"))
                       .where(F.col("df") >= least).drop("df"), "audit-kept")
    cells = materialize(counted.drop("df").join(kept, ["lang", "term"]), "audit-cells")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = materialize(
        docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_")).join(langs, "lang", "left")
        .join(totals, ["lang", "source"], "left").select(
            "lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("lang_total", zero).alias("lang_total"),
            F.coalesce("total", zero).alias("total"),
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("at"),
            F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources"))
        .withColumn("p0", weight(zero, F.col("total"), F.col("v"))), "audit-groups")
    weighed = cells.join(groups, ["lang", "source"]).withColumn("p", weight(F.col("n"), F.col("total"), F.col("v")))

    q = weight(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (weighed.withColumn("q", q).where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     difference(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top))

    place = [F.floor(F.col("at") / side).alias("block"), (F.col("at") % side).alias("g")]
    stripes = F.ceil(F.col("v") / stripe)
    last = F.floor((F.col("sources") - 1) / side)
    rows = weighed.select("lang", F.pmod(F.xxhash64("term"), stripes).alias("stripe"), *place, "p", "term", last.alias("last"))
    zeros = groups.where("v > 0").select("lang", F.explode(F.sequence(zero, stripes - 1)).alias("stripe"), *place,
                                         F.col("p0").alias("p"), F.lit(None).cast("string").alias("term"), last.alias("last"))
    met = rows.unionByName(zeros).select("*", F.explode(F.sequence(zero, F.col("last"))).alias("other")).select(
        "lang", "stripe", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "g", "p", "term")
    sums = (met.groupBy("lang", "stripe", "x", "y")
            .applyInArrow(lambda t: _traverse(t, side), "lang string, a long, b long, sum long, terms long")
            .groupBy("lang", "a", "b").agg(F.sum("sum").alias("sum"), F.sum("terms").alias("terms")))
    one = groups.select("lang", "source", "v", F.col("at").alias("i"), F.col("p0").alias("pi"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("j"), F.col("p0").alias("pj"))
    pairs = one.join(two, "lang").where("i <> j").select(
        "*", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).join(sums, ["lang", "a", "b"], "left")
    # terms that neither group has, and that no tile held, all differ by the same
    unseen = (F.col("v") - F.coalesce("terms", zero)) * difference(F.col("pi"), F.col("pj"))
    value = F.when(F.col("v") > 0, F.coalesce("sum", zero) + unseen).otherwise(zero)
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn(
        "rank", F.row_number().over(over))
    return terms.unionByName(ranked)
