"""Removal of repeated passages, found by difference-cover anchors.

A passage is a window of ``window`` consecutive words. Of windows with the same words all but the earliest (smaller id,
then earlier start) are repeats, and every word that a repeat covers is removed; what is left of the others is not
judged again.

Anchors: short windows of ``window - period + 1`` words are hashed only where the position modulo ``period`` is in a
difference cover. For any two positions some shift below the period brings both onto the cover, so two equal windows
share an equal anchor at the same place inside both: anchors at 4 of 13 positions find every repeat of 20 words.
Extension: only windows around anchors that occur more than once are hashed whole, by 96 bits, and compared.

Scale: two shuffles of plain rows, one of anchors and one of the windows around shared anchors. Before either, a task
pre-aggregates: of equal hashes within about ``chunk`` rows only the first keeps its key; the others are already known
to be repeats and are dealt evenly. So a passage that a third of all documents hold, or one document of one repeated
word, gives one row per chunk and no hot task. Text is shuffled at most twice, by document, and not at all where the
positions to look at are few enough for a broadcast, whose size is counted first. What is collected per document are
positions in that document, never members of a group.

Defined cases: words are runs of anything but ASCII white space, case counts; null text has none. A text of fewer than
``window`` words keeps all. A null id is smaller than any other. Rows of the same id are ordered by the hash of their
text; of rows with the same id and text one is the earlier, so the others lose all words that windows cover. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm import bytesx
from wardspark.llm.common import BROADCAST_BYTES, SLICE_BYTES, map_batches
from wardspark.session import materialize

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
NULL_ID = -(1 << 63)


def difference_cover(period: int) -> tuple[int, ...]:
    """The smallest set of residues whose differences are all residues; the first of its size in order."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("period must be at least 1")


def period_for(window: int, anchor: int = 8, most: int = 31) -> int:
    """The period with the sparsest cover that leaves anchors of at least ``anchor`` words, or what the window has."""
    longest = max(1, min(most, window - min(anchor, window) + 1))
    # planar difference sets: q * q + q + 1 positions for q + 1 residues
    return max(p for p in (1, 3, 7, 13, 21, 31) if p <= longest)


def _hash_at(h: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on."""
    out = np.full(len(at), seed, np.uint64)
    for j in range(length):
        out = bytesx.mix(out * _R + h[at + j])
    return out


def _words(data: np.ndarray, off: np.ndarray):
    """Hashes of the words of a slice, the first word of each row, and the number of words of each row."""
    h, row = bytesx.words(data, off)
    count = np.bincount(row, minlength=len(off) - 1)
    return h, np.cumsum(count) - count, count


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within runs of the given lengths."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _chunks(b: pa.RecordBatch, text: int, find, limit: int):
    """Joined arrays of ``find(hashes, first word, words, lo, hi)`` over slices of a batch, some ``limit`` rows each."""
    data, off = bytesx.column_bytes(b.column(text))
    held: list[tuple] = []
    size = 0
    for lo, hi in bytesx.slices(off, SLICE_BYTES):
        part = find(*_words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]), lo, hi)
        held.append(part)
        size += len(part[0])
        if size >= limit:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _integers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def shared_anchors(docs: DataFrame, window: int, period: int, chunk: int) -> DataFrame:
    """(doc, at): for each document the positions of its anchors that occur more than once."""
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    length = window - period + 1

    def find(h, first, count, lo, hi, doc):
        size = np.where(count >= window, count - length + 1, 0)
        pos = _within(size)
        keep = cover[pos % period]
        row = np.repeat(np.arange(hi - lo), size)[keep]
        pos = pos[keep]
        return _hash_at(h, first[row] + pos, length, 1), doc[lo:hi][row], pos

    def one(b):
        doc = _integers(b.column(0))
        for g, d, pos in _chunks(b, 1, lambda *a: find(*a, doc), chunk):
            order = np.argsort(g, kind="stable")
            new = np.diff(g[order], prepend=g[order[:1]] ^ _U(1)) != 0
            again = np.zeros(len(g), bool)
            again[order] = ~new
            shared = np.zeros(len(g), bool)
            shared[order] = ~new | np.append(~new[1:], False)
            spread = bytesx.mix(d.view(np.uint64) * _R + pos.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(again, spread, g).view(np.int64)), pa.array(d), pa.array(pos << 1 | shared)],
                ["g", "doc", "p"])

    found = map_batches(docs.select("doc", "text"), one, "g long, doc long, p long")
    counted = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    return (counted.where((F.col("n") > 1) | (F.col("p").bitwiseAND(F.lit(1)) == 1))
            .groupBy("doc").agg(F.collect_list(F.shiftright("p", 1)).alias("at")))


def _spans(rows: DataFrame, keys: list[str], before: int, after: int, name: str) -> tuple[DataFrame, int]:
    """``at`` as ascending disjoint ranges [at - before, at + after) in lists ``lo`` and ``hi``; and their bytes."""
    def one(b):
        lists = b.column(len(keys))
        off = lists.offsets.to_numpy().astype(np.int64)
        at = lists.flatten().to_numpy()
        off = off - off[0]
        row = np.repeat(np.arange(b.num_rows), np.diff(off))
        order = np.lexsort((at, row))
        at = at[order]
        lo, hi = np.maximum(at - before, 0), at + after
        begin = np.ones(len(at), bool)
        begin[1:] = (lo[1:] > hi[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(at)) - 1
        parts = np.concatenate([[0], np.cumsum(np.bincount(row[starts], minlength=b.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(len(keys))), pa.ListArray.from_arrays(pa.array(parts), pa.array(lo[starts])),
             pa.ListArray.from_arrays(pa.array(parts), pa.array(hi[ends]))], [*keys, "lo", "hi"])

    types = ", ".join(f"{k} long" for k in keys)
    spans = materialize(map_batches(rows.select(*keys, "at"), one, f"{types}, lo array<long>, hi array<long>"), name)
    n, parts = spans.agg(F.count(F.lit(1)), F.sum(F.size("lo"))).first()
    return spans, 64 * n + 16 * (parts or 0)


def _join(docs: DataFrame, spans: DataFrame, size: int, keys: list[str], how: str) -> DataFrame:
    return docs.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, keys, how)


def _ranges(b: pa.RecordBatch, lo_at: int):
    """Ranges of a batch: their row, begin and end."""
    parts = b.column(lo_at)
    if parts.null_count:
        parts = pa.array(parts.to_pylist(), parts.type)
    n = np.nan_to_num(parts.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    hi = b.column(lo_at + 1)
    return np.repeat(np.arange(b.num_rows), n), parts.flatten().to_numpy(), hi.flatten().to_numpy()


def repeated_windows(docs: DataFrame, spans: DataFrame, size: int, window: int, chunk: int) -> DataFrame:
    """(doc, tie, at): for each document the starts of its windows that also start earlier."""
    def find(h, first, count, lo, hi, doc, tie, ranges):
        row, begin, end = ranges
        here = (row >= lo) & (row < hi)
        row, begin = row[here] - lo, begin[here]
        n = np.maximum(np.minimum(end[here], count[row] - window + 1) - begin, 0)
        at = np.repeat(begin, n) + _within(n)
        row = np.repeat(row, n)
        word = first[row] + at
        return (_hash_at(h, word, window, 2), (_hash_at(h, word, window, 3) >> _U(33)).astype(np.int64),
                doc[lo:hi][row], tie[lo:hi][row], at)

    def one(b):
        doc, tie = _integers(b.column(0)), _integers(b.column(1))
        ranges = _ranges(b, 3)
        for w, x, d, t, at in _chunks(b, 2, lambda *a: find(*a, doc, tie, ranges), chunk):
            order = np.lexsort((at, t, d, x, w))
            w, x, d, t, at = w[order], x[order], d[order], t[order], at[order]
            if not len(w):
                continue
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (x[1:] != x[:-1])
            least = np.flatnonzero(new)[np.cumsum(new) - 1]
            copy = ~new & (d == d[least]) & (t == t[least]) & (at == at[least])  # rows of the same id and text
            again = ~new & ~copy
            spread = bytesx.mix(d.view(np.uint64) * _R + at.astype(np.uint64))
            keep = ~copy
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(again, spread, w).view(np.int64)[keep]),
                 pa.array(np.where(again, -1, x).astype(np.int32)[keep]), pa.array(d[keep]), pa.array(t[keep]),
                 pa.array((at << 1 | again)[keep])], ["w", "x", "doc", "tie", "s"])

    near = _join(docs.select("doc", "tie", "text"), spans, size, ["doc"], "inner").select("doc", "tie", "text", "lo", "hi")
    found = map_batches(near, one, "w long, x int, doc long, tie long, s long")
    ranked = found.withColumn("r", F.rank().over(Window.partitionBy("w", "x").orderBy("doc", "tie", "s")))
    return (ranked.where((F.col("r") > 1) | (F.col("s").bitwiseAND(F.lit(1)) == 1))
            .groupBy("doc", "tie").agg(F.collect_list(F.shiftright("s", 1)).alias("at")))


def _kept(data: np.ndarray, off: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Per row of a slice: words, removed words, and the kept words joined by blanks, as bytes with row offsets."""
    starts, ends = bytesx.runs(~bytesx.SPACE[data], off)
    word_row = bytesx.rows_of(starts, off)
    n = np.bincount(word_row, minlength=len(off) - 1)
    first = np.cumsum(n) - n
    edge = np.zeros(len(starts) + 1, np.int64)
    begin, end = np.minimum(begin, n[row]), np.minimum(end, n[row])
    np.add.at(edge, first[row] + begin, 1)
    np.add.at(edge, first[row] + end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    removed = np.bincount(word_row[gone], minlength=len(n))
    starts, ends, word_row = starts[~gone], ends[~gone], word_row[~gone]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    np.add.at(inside, ends, -1)
    mask = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    gaps = ends[:-1][word_row[1:] == word_row[:-1]]  # the blank behind a word that another follows
    text = data.copy()
    text[gaps] = 0x20
    mask[gaps] = True
    return n, removed, text[mask], np.concatenate([[0], np.cumsum(mask)])[off]


def repeats_removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                    period: int | None = None, chunk: int = 400_000, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row; ``kept``, the words left, if asked for."""
    period = period or period_for(window)
    if not 1 <= period <= window:
        raise ValueError("the period must lie between 1 and the window")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    repeats = docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    # where no id repeats, ids alone identify and order the rows
    tie = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long") if repeats else F.lit(0).cast("long")
    docs = docs.withColumn("tie", tie)
    anchors = shared_anchors(docs, window, period, chunk)
    near, near_bytes = _spans(anchors, ["doc"], period - 1, 1, "substring-near")
    again = repeated_windows(docs, near, near_bytes, window, chunk)
    gone, gone_bytes = _spans(again, ["doc", "tie"], 0, window, "substring-gone")

    def one(b):
        data, off = bytesx.column_bytes(b.column(2))
        row, begin, end = _ranges(b, 3)
        for lo, hi in bytesx.slices(off, SLICE_BYTES):
            here = (row >= lo) & (row < hi)
            n, removed, text, cut = _kept(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], row[here] - lo, begin[here],
                                          end[here])
            raw = text.tobytes()
            sha = [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            kept = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(raw))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n), pa.array(removed),
                 pa.array(sha), kept if texts else pa.nulls(hi - lo, pa.string())],
                ["doc_id", "tie", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = _join(docs, gone, gone_bytes, ["doc", "tie"], "left").select("doc_id", "tie", "text", "lo", "hi")
    out = map_batches(joined, one, "doc_id long, tie long, n_words long, n_removed long, kept_sha256 string, kept string")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    if not repeats:
        return out.select(*names)
    # of rows with the same id and text one is the earlier: each other one repeats all its windows
    grouped = out.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in names[1:]))
    each = grouped.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    later = (F.col("i") > 1) & (F.col("n_words") >= window)
    return each.select("doc_id", "n_words", F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
                       F.when(later, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
                       F.when(later & F.col("kept").isNotNull(), F.lit("")).otherwise(F.col("kept")).alias("kept"))
