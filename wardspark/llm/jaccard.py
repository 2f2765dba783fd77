"""Jaccard self-join of texts on word n-grams: MinHash in fixed bands, then exact verification.

Texts are sets of hashed word k-grams. Two texts are candidates if they share all minima of one of ``trees`` bands. A
band's length is fixed before the scan: the longest, ``depth`` at most, at which a pair at the threshold is found with
the target recall, 1 - (1 - t^length)^trees; more alike pairs are found more surely.

This is banding and not an LSH forest: no signatures are sorted, and no prefix is shortened row by row. A forest stops
at longer prefixes for queries that want their few nearest texts; here every pair above a known threshold is wanted, so
every row would go down to the shortest length anyway, and the longer prefixes find only pairs that it finds too.

Verification is exact and takes no pair twice. Texts that buckets connect, also by a chain of them, have their homes
together in blocks of about ``block`` texts and ``block_grams`` shingles; where a chain is cut, texts whose least
bucket mate is the same stay together. Two blocks meet if members of both share a bucket anywhere. A meeting counts
the shingles that its texts share in numpy and returns per text the number of its partners and one edge to the least
text it is connected to within the meeting, never the pairs.
Classes are the components of those edges.

Exact copies are reduced to one text by MD5 before any of this, so a group of equal texts is one row. All steps
work on whole texts; nothing is capped. A group of g near but different texts is shuffled once
if it fits a block, and else costs about g^2 / block rows of shuffle.

Scale: the first scan returns a signature per row (``trees`` longs); text is shuffled once, for rows that have
partners. No step is bound to a key's size: the joins on bucket, copy and block are plain equi-joins that adaptive
execution splits, and aggregation is partial first.

Defined cases: words are runs of anything but ASCII white space, case counts. A text of 1 to k-1 words has all of them
as its only shingle; a text without words (also null) has no shingle and no partner, and is its own class. Rows may
repeat an id; their texts are joined as texts, and each row gets its text's class. A null id is kept as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import bytesx
from wardspark.llm.common import BROADCAST_BYTES, SLICE_BYTES, join_checked, map_batches, release, written
from wardspark.llm.components import components
from wardspark.session import materialize


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is found with the target recall; at least 1."""
    length = depth
    while length > 1 and 1 - (1 - threshold ** length) ** trees < recall:
        length -= 1
    return length


def signatures(shingles: np.ndarray, offsets: np.ndarray, trees: int, length: int, seed: int = 1) -> np.ndarray:
    """One 64-bit prefix key per row and tree, mixed from ``length`` minima; rows without shingles get zeros."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 62, (trees, length), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((n, trees), np.uint64)
    if not len(full):
        return out
    starts = offsets[full]
    for t in range(trees):
        key = np.full(len(full), t + 1, np.uint64)
        for j in range(length):
            least = np.minimum.reduceat(shingles * mult[t, j] >> np.uint64(16), starts)
            key = bytesx.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[full, t] = key
    return out


def _sign(docs: DataFrame, k: int, trees: int, length: int) -> DataFrame:
    def one(b):
        data, off = bytesx.column_bytes(b.column(2))
        n = len(off) - 1
        for lo, hi in bytesx.slices(off, SLICE_BYTES):
            h, row = bytesx.words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            s, so = bytesx.shingles(h, row, hi - lo, k)
            sig = signatures(s, so, trees, length).view(np.int64)
            size = np.diff(so)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * trees),
                                            pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(size), keys],
                ["doc_id", "md5", "size", "keys"])
        assert n >= 0
    return map_batches(docs, one, "doc_id long, md5 binary, size long, keys array<long>")


def _shingled(rows: DataFrame, k: int) -> DataFrame:
    """(tid, n, text) to (tid, n, grams): the sorted distinct shingles."""
    def one(b):
        data, off = bytesx.column_bytes(b.column(2))
        for lo, hi in bytesx.slices(off, SLICE_BYTES):
            h, row = bytesx.words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            s, so = bytesx.shingles(h, row, hi - lo, k)
            grams = pa.ListArray.from_arrays(pa.array(so.astype(np.int32)), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), grams],
                                             ["tid", "n", "grams"])
    return map_batches(rows, one, "tid long, n long, grams array<long>")


def linked(grams: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float,
           width: int = 512, light: int = 64) -> np.ndarray:
    """Matrix over left x right (row numbers): whether the Jaccard similarity reaches the threshold.

    A shingle that few pairs of the two sides share adds to those pairs one by one; the others are columns of blocked
    matrix products.
    """
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    n_values = len(count)
    column = column.astype(np.int32)
    keep = (count > 1)[column]
    row, column = row[keep], column[keep]
    del count, keep
    sides = []
    for side in (left, right):
        place = np.full(len(size), -1, np.int32)
        place[side] = np.arange(len(side), dtype=np.int32)
        p = place[row]
        at, p = column[p >= 0], p[p >= 0]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], p[order], np.bincount(at, minlength=n_values).astype(np.int32)))
    del row, column
    (at_l, row_l, n_l), (at_r, row_r, n_r) = sides
    shared = np.zeros(len(left) * len(right), np.float32)
    pairs = n_l.astype(np.int64) * n_r
    first_r = np.cumsum(n_r) - n_r
    use = np.flatnonzero(pairs[at_l] * (pairs[at_l] <= light) > 0)
    step = max(1, 500_000 // light)
    for lo in range(0, len(use), step):
        e = use[lo:lo + step]
        n = n_r[at_l[e]]
        partner = np.repeat(first_r[at_l[e]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        np.add.at(shared, np.repeat(row_l[e].astype(np.int64), n) * len(right) + row_r[partner], np.float32(1))
    shared = shared.reshape(len(left), len(right))
    heavy = np.flatnonzero(pairs > light)
    new = np.full(n_values, -1, np.int32)
    new[heavy] = np.arange(len(heavy))
    for lo in range(0, len(heavy), width):
        both = []
        for at, r, n in ((at_l, row_l, len(left)), (at_r, row_r, len(right))):
            c = new[at]
            inside = (c >= lo) & (c < lo + width)
            m = np.zeros((n, min(width, len(heavy) - lo)), np.float32)
            m[r[inside], c[inside] - lo] = 1
            both.append(m)
        for top in range(0, len(left), ROWS):
            shared[top:top + ROWS] += both[0][top:top + ROWS] @ both[1].T
    out = np.empty(shared.shape, bool)
    for top in range(0, len(left), ROWS):
        s = shared[top:top + ROWS]
        union = size[left[top:top + ROWS]][:, None] + size[right][None, :] - s
        out[top:top + ROWS] = s / np.maximum(union, 1).astype(np.float64) >= threshold
    return out


#: Rows of a matrix of pairs that one step holds in wide numbers.
ROWS = 128


def _least_of_links(match: np.ndarray, of_right: np.ndarray) -> np.ndarray:
    """For each row the least of ``of_right`` among its links; the greatest number for a row without links."""
    top = np.iinfo(np.int64).max
    return np.concatenate([np.where(match[lo:lo + ROWS], of_right[None, :], top).min(1, initial=top)
                           for lo in range(0, len(match), ROWS)] or [np.zeros(0, np.int64)])


def _count_links(match: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of ``weight`` over the links of each row."""
    return np.concatenate([match[lo:lo + ROWS] @ weight for lo in range(0, len(match), ROWS)] or [np.zeros(0, np.int64)])


def _meet(t: pa.Table, threshold: float) -> pa.Table:
    """One meeting of two blocks (or of one with itself): partners and edge of each linked text."""
    t = t.combine_chunks()
    side, tid, n = (t[c].to_numpy() for c in ("side", "tid", "n"))
    _, first = np.unique(tid, return_index=True)
    lists = t["grams"].combine_chunks()
    if len(first) < len(tid):
        side, tid, n = side[first], tid[first], n[first]
        lists = lists.take(pa.array(first))
    grams, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    left = np.flatnonzero(side != 2)
    own = not np.any(side == 2)
    right = left if own else np.flatnonzero(side == 2)
    match = linked(grams, offsets, left, right, threshold)
    if own:
        np.fill_diagonal(match, False)
    links = np.zeros(len(tid), np.int64)
    links[left] += _count_links(match, n[right])
    if not own:
        links[right] += _count_links(match.T, n[left])
    root = tid.copy()
    while True:  # the least text id spreads along links until nothing changes
        new = root.copy()
        new[left] = np.minimum(root[left], _least_of_links(match, root[right]))
        new[right] = np.minimum(new[right], _least_of_links(match.T, new[left]))
        if np.array_equal(new, root):
            break
        root = new
    has = np.flatnonzero(links)
    out = pa.table({"tid": tid[has], "links": links[has], "root": root[has]})
    del match, grams, lists, t
    release()
    return out


def homes(texts: DataFrame, block: int, block_grams: int) -> DataFrame:
    """(tid, block) of texts (tid, label, size, chain); a block has about ``block`` texts and ``block_grams`` shingles.

    A chain that fits is one block. In a larger one, a label that takes more than a quarter of a block has blocks of
    its own, and the others share bins that are half full on average: blocks are as many as its texts need, times a
    constant, and never as many as its labels.
    """
    def blocks(n, size):
        return F.greatest(n / F.lit(block), size / F.lit(block_grams))
    of_label = texts.groupBy("chain", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    of_chain = of_label.groupBy("chain").agg(blocks(F.sum("n"), F.sum("grams")).alias("all"))
    of_label = of_label.select("chain", "label", blocks(F.col("n"), F.col("grams")).alias("own"))
    # not written: the labels are few beside the texts, and every written table costs a file per task
    sized = texts.select("tid", "chain", "label").join(of_label, ["chain", "label"]).join(of_chain, "chain")
    part = F.pmod(F.xxhash64("tid"), F.ceil("own"))
    bin_ = F.pmod(F.xxhash64("label"), F.ceil(2 * F.col("all")))
    return sized.select("tid", F.when(F.col("all") <= 1, F.xxhash64("chain")).when(
        F.col("own") > 0.25, F.xxhash64("chain", "label", part)).otherwise(F.xxhash64("chain", bin_)).alias("block"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    threshold: float = 0.8, trees: int = 32, depth: int = 8, recall: float = 0.99999,
                    block: int = 2048, block_grams: int = 2_000_000) -> DataFrame:
    """(doc_id, md5, class_key, class_id, n_copies, n_links) for every row of ``df``.

    ``class_id``: the least id of the rows connected by links of at least ``threshold``; ``class_key`` tells classes
    apart even where ids repeat, null for a text without words; ``n_copies``: rows of the same text; ``n_links``: other
    rows whose similarity reaches the threshold, copies included.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = docs.withColumn("md5", F.unhex(F.md5(F.col("text"))))
    length = prefix_length(threshold, trees, depth, recall)
    signed = materialize(_sign(keyed.select("doc_id", "md5", "text"), k, trees, length), "jaccard-rows")
    low = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n_rows = signed.count()
    texts = written(
        signed.groupBy("md5").agg(F.min(low).alias("first"), F.count(F.lit(1)).alias("n"),
                                  F.min(F.col("doc_id")).alias("least"), F.max("size").alias("size"),
                                  F.first("keys").alias("keys"))
        .withColumn("tid", F.monotonically_increasing_id()), "jaccard-texts", n_rows, 25_000)
    n_texts = texts.count()
    in_tree = texts.where("size > 0").select("tid", "size", F.explode("keys").alias("bucket"))
    buckets = in_tree.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("tid").alias("low")).where(
        "members > 1").drop("members")
    member = written(in_tree.join(buckets, "bucket"), "jaccard-members", n_texts * trees, 1_000_000)
    label = written(member.groupBy("tid").agg(F.min("low").alias("label"), F.first("size").alias("size")),
                    "jaccard-labels", n_texts, 250_000)
    # texts that a chain of buckets connects share their blocks, so a bucket lies in few of them, whatever its size
    chains = components(member.select(F.col("tid").alias("a"), F.col("low").alias("b")))
    home = homes(label.join(chains.select(F.col("id").alias("tid"), F.col("root").alias("chain")), "tid"),
                 block, block_grams)
    seen = member.select("tid", "bucket").join(home, "tid").select("bucket", "block").distinct()
    across = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("bucket")
    cut = seen.join(across, "bucket")
    a, b = cut.alias("a"), cut.alias("b")
    meetings = a.join(b, F.col("a.bucket") == F.col("b.bucket")).where("a.block < b.block").select(
        F.col("a.block").alias("x"), F.col("b.block").alias("y")).union(
        home.select(F.col("block").alias("x"), F.col("block").alias("y"))).distinct()
    sides = meetings.select(F.xxhash64("x", "y").alias("meeting"), F.explode(F.when(
        F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("x").alias("block"), F.lit(1).alias("side")),
                F.struct(F.col("y").alias("block"), F.lit(2).alias("side"))))).alias("s")).select(
        "meeting", "s.block", "s.side")
    # text is read again for rows with partners only; where those are few, it isn't shuffled either
    chosen = label.select("tid").join(texts.select("tid", "md5", "first", "n"), "tid").select("tid", "md5", "first", "n")
    few = label.count() * 96 <= BROADCAST_BYTES
    with_text = keyed.withColumn("first", low).join(F.broadcast(chosen) if few else chosen, ["md5", "first"])
    grams = _shingled(with_text.select("tid", "n", "text"), k).join(home, "tid")
    met = (grams.join(sides, "block").select("meeting", "side", "tid", "n", "grams").groupBy("meeting")
           .applyInArrow(lambda t: _meet(t, threshold), "tid long, links long, root long"))
    found = materialize(met, "jaccard-found")
    links = found.groupBy("tid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("tid").alias("a"), F.col("root").alias("b")))
    least = texts.select("tid", "least").join(roots.withColumnRenamed("id", "tid"), "tid")
    class_of = least.groupBy("root").agg(F.min("least").alias("class_id"))
    classed = least.select("tid", "root").join(class_of, "root").join(links, "tid").select(
        "tid", "root", "class_id", "links")
    words = F.col("size") > 0
    answer = texts.select("md5", "tid", "n", "least", "size").join(classed, "tid", "left").select(
        "md5", "n", F.when(words, F.coalesce("root", "tid")).alias("class_key"),
        F.when(words, F.coalesce("class_id", "least")).alias("class_id"),
        F.when(words, F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(F.lit(0)).alias("links"))
    return signed.select("doc_id", "md5").join(answer, "md5").select(
        "doc_id", "md5", "class_key", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.col("n").alias("n_copies"), F.col("links").alias("n_links"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one row of each class: that with the least id, of equal ids the least MD5.

    Rows without words are no copies of anything and stay. The rows to drop are looked for, as they are fewer.
    """
    n_rows = df.count()
    found = written(near_duplicates(df, id_col, text_col, **options), "jaccard-classes", n_rows, 50_000)
    classed = found.where("class_key is not null")
    row = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "md5")
    keep = classed.groupBy("class_key").agg(F.min(row).alias("k")).select("k.id", "k.md5")
    rows = classed.groupBy(row["id"].alias("id"), "md5").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.join(keep.withColumn("kept", F.lit(True)), ["id", "md5"], "left").select(
        F.col("id").alias("_llm_id"), F.col("md5").alias("_llm_md5"), "n", "kept"), "jaccard-decisions", n_rows, 100_000)
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    md5 = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    keyed = df.withColumns({"_llm_id": own_id, "_llm_md5": md5})
    key = ["_llm_id", "_llm_md5"]
    single = join_checked(keyed, rows.where("kept is null").select(*key), key, "left_anti")
    again = rows.where("kept and n > 1").select(*key)
    if not again.limit(1).count():
        return single.select(*df.columns)
    # of rows that repeat the kept one, id and text, any one stays
    twice = join_checked(single, again, key, "left_semi").groupBy(*key).agg(
        F.first(F.struct(*df.columns)).alias("_llm_row")).select("_llm_row.*")
    return join_checked(single, again, key, "left_anti").select(*df.columns).unionByName(twice)
