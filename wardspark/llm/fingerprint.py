"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is a sequence of units, led by a mark for its beginning: words (runs of anything but ASCII white space), but each
character by itself in scripts written without blanks and in runs of more than ``LONGEST`` characters. Inside every
k-mer of words the hashes of its inner s-mers are compared; the k-mer is a closed syncmer if the least of them is the
first or the last. Whether a k-mer is chosen depends on its own words alone, so unchanged passages give the same
anchors in any document, wherever they stand; neighbouring k-mers overlap by whole s-mers, so gaps are short.

``anchors`` returns all anchors with positions. ``matched`` compares two texts by position: what counts is an anchor
together with the next one and the distance between them, so an unchanged passage matches wherever it stands, and the
same anchors in another order or at other distances do not. ``fingerprint`` is the bounded form for whole
documents: the ``size`` least distinct anchor hashes, 8 hexadecimal digits each, in ascending order of the signed
numbers. Fingerprints of up
to ``size`` anchors hold all of them; beyond that it is a uniform sample, the same in all documents. ``likeness`` of
two fingerprints is the Jaccard similarity of their anchor sets: exact if both are complete, else estimated on the
``size`` least of their union.

k = 4 and s = 2 are fixed: three inner s-mers, of which the middle one must not be the strict minimum.

Defined cases: null counts as empty. A text without units has the empty fingerprint; two empty ones have likeness 1,
an empty and another one 0. Texts of fewer than k words are led by as many marks as a k-mer needs, so one unit
suffices for an anchor. Rows of equal text get equal fingerprints; white space between words has no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 128
#: Characters of a word beyond which each of them is a unit.
LONGEST = 64
# Fixed ranges: Thai, Lao, Myanmar, Khmer, CJK with kana and full-width forms, and the later ideographs.
_UNSPACED = (r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\uFF00-\uFFEF"
             r"\x{20000}-\x{3FFFF}")


def units(text: Column) -> Column:
    """The units of a text: its words, and the characters of unspaced scripts and of very long words."""
    text = F.coalesce(text, F.lit(""))
    apart = F.when((F.octet_length(text) > F.length(text)) & text.rlike(f"[{_UNSPACED}]"),
                   F.regexp_replace(text, f"([{_UNSPACED}])", " $1 ")).otherwise(text)
    words = F.filter(F.split(apart, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return words


def _cut(words: Column) -> Column:
    """``words`` with those of more than ``LONGEST`` characters replaced by their characters."""
    return F.when(F.exists(words, lambda w: F.length(w) > LONGEST), F.flatten(F.transform(
        words, lambda w: F.when(F.length(w) > LONGEST, F.split(w, "(?!^)(?!$)")).otherwise(F.array(w))))).otherwise(words)


def _mers(df: DataFrame, source: str, out: str) -> DataFrame:
    """Adds ``out``: the s-mer hashes of the words in ``source``, led by three marks; few steps over each word."""
    h, shifted = f"{out}_h", f"{out}_t"
    marks = F.array(*(F.lit(9223372036854775807 - i).cast("long") for i in range(3)))
    df = df.withColumn(h, F.concat(marks, F.transform(F.col(source), lambda w: F.xxhash64(w))))
    df = df.withColumn(shifted, F.slice(h, F.lit(2), F.size(h)))
    # the last pair has no second word; its hash is cut off below
    pairs = F.zip_with(h, shifted, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return df.withColumn(out, pairs).drop(h, shifted)


def with_anchors(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds ``out``: array<struct<pos, hash>> of all closed syncmers; pos counts the units before the k-mer's end.

    A k-mer spans the s-mers i, i + 1 and i + 2; it is chosen unless s-mer i + 1 is the strict minimum. The marks'
    own s-mers never are the minimum, as they are replaced by the largest value.
    """
    w, m = f"{out}_w", f"{out}_m"
    df = _mers(df.withColumn(w, units(text)).withColumn(w, _cut(F.col(w))), w, m)
    n = F.size(m)
    largest = F.lit(9223372036854775807)

    def at(i):
        return F.get(F.col(m), i)

    def key(i):
        return F.when(i < 2, largest).otherwise(at(i))

    # index i of the first s-mer; the last k-mer begins at n - 4, as the last pair is no s-mer
    picks = F.filter(F.sequence(F.lit(0), n - 4), lambda i: ~((key(i + 1) < key(i)) & (key(i + 1) < key(i + 2))))
    chosen = F.transform(picks, lambda i: F.struct(
        i.alias("pos"), F.xxhash64(at(i), at(i + 2)).alias("hash")))
    empty = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return df.withColumn(out, F.when(F.size(w) > 0, chosen).otherwise(empty)).drop(w, m)


def sketch(anchors: Column, size: int = SIZE) -> Column:
    """The ``size`` least distinct anchor hashes, as sorted 32-bit numbers."""
    short = F.transform(anchors, lambda a: F.shiftright(a["hash"], 32).cast("int"))
    return F.slice(F.array_sort(F.array_distinct(short)), 1, size)


def fingerprint(parts: Column) -> Column:
    """The numbers of a sketch as 8 hexadecimal digits each."""
    digits = F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Jaccard similarity of two sketches, on the ``size`` least hashes of their union."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def links(anchors: Column) -> Column:
    """One hash per anchor and the next one with their distance; a lone anchor is a link by itself."""
    pairs = F.zip_with(anchors, F.slice(anchors, F.lit(2), F.greatest(F.size(anchors), F.lit(1))),
                       lambda a, b: F.xxhash64(a["hash"], b["hash"], b["pos"] - a["pos"]))
    return F.when(F.size(anchors) > 1, F.slice(pairs, F.lit(1), F.greatest(F.size(anchors) - 1, F.lit(1)))).otherwise(
        F.transform(anchors, lambda a: a["hash"]))


def matched(a: Column, b: Column) -> Column:
    """Share of the distinct links of the first anchors that the second have too; 1 if the first have none."""
    own = F.array_distinct(links(a))
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(own, links(b))) / F.greatest(F.size(own), F.lit(1)))


def anchors(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and one row per anchor: pos (units before the end of its k-mer), hash."""
    keep = list(keep or [])
    rows = with_anchors(df.select(*keep, F.col(text_col).alias("_llm_text")), F.col("_llm_text"), "_llm_a")
    return rows.select(*keep, F.explode("_llm_a").alias("_llm_x")).select(*keep, "_llm_x.pos", "_llm_x.hash")
