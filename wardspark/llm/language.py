"""Language identification with bit-sliced Bloom filters over character n-grams.

Every language has a Bloom filter of the n-grams that are characteristic for it. The filters are bit-sliced: slot i
holds bit i of all filters, so the AND of an n-gram's slots is the set of languages whose filter contains it, as a
bitmask. A text's n-grams are counted per language (popcount of each bit over its masks); the count is corrected for
the filter's false positives, and the language with the largest corrected share wins.

Learning reads all rows given. N-grams are counted per language and kept for those languages in which they are about
as frequent as in the language that uses them most, so a few mislabelled texts don't enter a filter.

Size bounds: the filters are ``slots`` machine words per 63 languages (2 MB for up to 8 languages at the default), at
any size of the corpus; that array is what the tasks receive.

Defined cases: a null or empty text and one without any letter get ``und`` and score 0. A text is lower-cased (ASCII
and Latin-1) and its runs of non-letters count as one gap. Rows whose language is null are not learned from. Without
any learned language every text is ``und``. Equal texts get equal answers; ties go to the smaller language name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm import bytesx
from wardspark.llm.common import SLICE_BYTES, map_batches, release, scanned

_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
WORD_BITS = 63


@dataclass
class Filters:
    """``words[j]``: for each slot the bits of languages 63 j to 63 j + 62; ``filled``: each filter's share of ones."""

    languages: list[str]
    words: list[np.ndarray]
    filled: np.ndarray
    hashes: int


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-byte grams of each row and their row offsets; each row is framed by two gaps on either side."""
    low = bytesx.lower(data)
    letter = bytesx.LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter after a letter stays, as the gap
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets] = True
    keep &= ~(row_start[:-1] & ~letter)
    low = np.where(letter, low, 0x20).astype(np.uint8)
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    size = np.diff(kept)
    n = len(size)
    out = np.full(int(size.sum()) + 4 * n, 0x20, np.uint32)
    start = kept[:-1] + 4 * np.arange(n)
    at = np.arange(int(size.sum())) + np.repeat(4 * np.arange(n) + 2, size)
    out[at] = low[keep]
    g = np.zeros(len(out), np.uint32)
    m = len(out) - 3
    if m > 0:
        g[:m] = out[:m] | out[1:m + 1] << np.uint32(8) | out[2:m + 2] << np.uint32(16) | out[3:m + 3] << np.uint32(24)
    valid = np.ones(len(out), bool)
    for j in range(1, 4):
        valid[start + size + 4 - j] = False
    return g[valid], np.concatenate([start, [len(out)]]) - 3 * np.arange(n + 1)


def positions(g: np.ndarray, slots: int, j: int) -> np.ndarray:
    """Slot of each n-gram under hash function ``j``."""
    shift = np.uint64(64 - slots.bit_length() + 1)
    return (((g.astype(np.uint64) + np.uint64(j + 1)) * np.uint64(_MULT[j])) >> shift).astype(np.int64)


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", slots: int = 1 << 21, hashes: int = 3,
          min_count: int = 2, keep_ratio: float = 0.3) -> Filters:
    """Filters from all rows of ``df`` that have a language."""
    known = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    names = sorted(r["lang"] for r in known.groupBy("lang").agg(F.lit(1)).select("lang").collect())
    index = {x: i for i, x in enumerate(names)}

    def count(batches):
        found: dict[int, list] = {}

        def merged(parts):
            g = np.concatenate([p[0] for p in parts])
            c = np.concatenate([p[1] for p in parts])
            u, inv = np.unique(g, return_inverse=True)
            return u, np.bincount(inv, c, len(u)).astype(np.int64)

        for b in batches:
            data, off = bytesx.column_bytes(b.column(0))
            lang = np.array([index[x] for x in b.column(1).to_pylist()], np.int64)
            for lo, hi in bytesx.slices(off, SLICE_BYTES):
                g, at = grams(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                of = np.repeat(lang[lo:hi], np.diff(at))
                for i in np.unique(lang[lo:hi]):
                    parts = found.setdefault(int(i), [])
                    parts.append(np.unique(g[of == i], return_counts=True))
                    if len(parts) > 8:
                        found[int(i)] = [merged(parts)]
        for i, parts in found.items():
            u, c = merged(parts)
            for k in range(0, len(u), 1 << 16):
                v = u[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), i, np.int32)), pa.array(v.astype(np.int64)),
                     pa.array(c[k:k + (1 << 16)])], ["lang", "gram", "n"])
        found.clear()
        release()

    counts = known.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= min_count)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = F.col("n") / F.col("total")
    rated = counts.join(F.broadcast(totals), "lang").select("lang", "gram", rate.alias("rate"))
    top = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("top", top).where(F.col("rate") >= keep_ratio * F.col("top")).select("lang", "gram")

    def insert(batches):
        lang, gram = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            lang.append(b.column(0).to_numpy().astype(np.int64))
            gram.append(b.column(1).to_numpy())
        lang, gram = np.concatenate(lang), np.concatenate(gram)
        for w in np.unique(lang // WORD_BITS):
            own = lang // WORD_BITS == w
            bits = np.zeros(slots, np.int64)
            for j in range(hashes):
                np.bitwise_or.at(bits, positions(gram[own], slots, j), np.int64(1) << (lang[own] % WORD_BITS))
            at = np.flatnonzero(bits)
            for k in range(0, len(at), 1 << 16):
                s = at[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), w, np.int32)), pa.array(s.astype(np.int32)), pa.array(bits[s])],
                    ["word", "slot", "bits"])

    filled_slots = (kept.mapInArrow(insert, "word int, slot int, bits long").groupBy("word", "slot")
                    .agg(F.bit_or("bits").alias("bits")).toArrow())
    n_words = -(-max(len(names), 1) // WORD_BITS)
    words = [np.zeros(slots, np.int64) for _ in range(n_words)]
    of, at, bits = (filled_slots.column(i).to_numpy() for i in range(3))
    for w in range(n_words):
        words[w][at[of == w]] = bits[of == w]
    filled = np.array([np.count_nonzero(words[i // WORD_BITS] >> (i % WORD_BITS) & 1) / slots
                       for i in range(len(names))])
    if len(names) <= 8:
        words = [words[0].astype(np.uint8)]
    return Filters(names, words, filled, hashes)


def shares(f: Filters, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the winning language, its corrected share and the sum of all shares, for each row of a slice."""
    g, at = grams(data, offsets)
    n = np.maximum(np.diff(at), 1)
    false = f.filled ** f.hashes
    best, share, total = np.zeros(len(n), np.int64), np.full(len(n), -1.0), np.zeros(len(n))
    slots = len(f.words[0])
    where = [positions(g, slots, j) for j in range(f.hashes)]
    for w, bits in enumerate(f.words):
        mask = bits[where[0]]
        for p in where[1:]:
            mask &= bits[p]
        for i in range(w * WORD_BITS, min((w + 1) * WORD_BITS, len(f.languages))):
            hits = np.concatenate([[0], np.cumsum(mask >> (i % WORD_BITS) & 1, dtype=np.int64)])
            hits = hits[at[1:]] - hits[at[:-1]]
            x = np.clip((hits / n - false[i]) / max(1 - false[i], 1e-9), 0, 1)
            total += x
            best, share = np.where(x > share, i, best), np.maximum(x, share)
    return best, np.maximum(share, 0), total


def score_rows(f: Filters, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winning language and its part of all languages' shares, for each row of a slice."""
    best, share, total = shares(f, data, offsets)
    return best, np.where(total > 0, share / np.maximum(total, 1e-12), 0) * np.minimum(1, share + 0.5)


def identify(df: DataFrame, filters: Filters, text_col: str = "text", keep: list[str] | None = None,
             names: tuple[str, str] = ("lang_pred", "score"), own_share: bool = False) -> DataFrame:
    """``keep`` columns of ``df`` with the language and its score under ``names``.

    With ``own_share``, the score is the winner's own corrected share, which other languages don't lower.
    """
    keep = list(keep or [])
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    fields = [df.schema[c] for c in keep]
    taken, at = scanned(df, keep, text_col)
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in fields)
    schema = f"{schema}{', ' if fields else ''}`{names[0]}` string, `{names[1]}` double"

    def one(b):
        f = shared.value
        data, off = bytesx.column_bytes(b.column(at))
        n = len(off) - 1
        best, score = np.zeros(n, np.int64), np.zeros(n)
        any_letter = np.zeros(n, bool)
        for lo, hi in bytesx.slices(off, SLICE_BYTES):
            d, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            if f.languages:
                best[lo:hi], score[lo:hi] = shares(f, d, o)[:2] if own_share else score_rows(f, d, o)
            ascii_letter = np.concatenate([[0], np.cumsum(bytesx.LETTER[d] & (d < 0x80), dtype=np.int64)])
            any_letter[lo:hi] = ascii_letter[o[1:]] > ascii_letter[o[:-1]]
            for i in np.flatnonzero(~any_letter[lo:hi] & (np.diff(o) > 0)):
                any_letter[lo + i] = any(c.isalpha() for c in bytes(d[o[i]:o[i + 1]]).decode("utf-8", "replace"))
        label = np.array([*f.languages, "und"], object)
        known = any_letter & bool(f.languages)
        pred = label[np.where(known, best, len(f.languages))]
        return pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(len(keep))), pa.array(pred, pa.string()),
             pa.array(np.where(known, score, 0.0))], [*keep, *names])

    return map_batches(taken, one, schema)


def recognised(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_score: float = 0.25) -> DataFrame:
    """``df`` without the rows whose text is in no learned language: ``und``, or an own share below ``min_score``.

    The share is that of the n-grams which the winner's filter holds; it doesn't depend on how many languages there are.
    """
    filters = learn(df, text_col, lang_col)
    found = identify(df, filters, text_col, df.columns, ("_llm_lang", "_llm_score"), own_share=True)
    return found.where((F.col("_llm_lang") != "und") & (F.col("_llm_score") >= min_score)).select(*df.columns)
