"""Secret scan: wide detection of candidates, then a random forest that removes the false positives.

``dictionary`` makes one pass over all texts and counts every word by its 64-bit hash, and character transitions. A word
is known if it is seen at least ``min_count`` times and makes up ``min_share`` of all words, so that knowing a word means
the same in a corpus of any size.
``candidates`` scans whole texts. Candidates are blank-separated tokens with two digits and eight characters, or with
an assignment; the parts of every token, of any length, between quotes and non-ASCII characters, and again between
commas, brackets, ``&`` and ``?``; the forms that providers give to keys, wherever they stand; and the whole values of
keys that hold secrets. Near such a key or word, six characters without a digit are enough. Each is described by its
length, its character classes and transitions, how much of it dictionary
words cover, the path around it (key, URL, mail address, file path) and its neighbouring words. ``label`` marks the
findings that are sure either way, by the form of the value: these are the labelled findings that ``fit`` learns from,
unless a table of findings with a column ``label`` from reviewers is given. ``score`` applies the forest to every
candidate, also to those that no rule decides.

Size bounds: words are counted in a Spark aggregation that grows with the corpus; of them at most 1 / ``min_share`` can
be known (200,000 hashes, 1.6 MB), and the transitions are 64 x 64 numbers; both are broadcast.
The forest is fitted on at most ``max_findings`` labelled findings, the first by hash, half of each label; the bound
only limits the training set. All texts are counted, scanned and scored.

Defined cases: null and empty texts have no candidates. A candidate's start counts code points. Equal texts have equal
findings, repeated rows repeat them. With findings of one label only, every candidate gets that label's score (1 or
0); without any finding there are no rows. Candidates can overlap; ``redact`` replaces overlapping secrets by one mark. A
value has non-ASCII letters only as the value of a key that holds secrets, a blank only there and in quotes.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import bytesx
from wardspark.llm.common import SLICE_BYTES, join_checked, map_batches, release
from wardspark.session import materialize

SYMBOLS = 64
LONGEST = 4096
# Names of keys that hold secrets, forms that providers give to keys, words that mark an example.
SECRET_KEYS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key",
               "private_key", "auth", "credential", "bearer")
PROVIDER_FORMS = (r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}",
                  r"sk_live_[A-Za-z0-9]{16,}", r"AIza[0-9A-Za-z_-]{35}", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]{10,}")
EXAMPLE_WORDS = ("example", "changeme", "placeholder", "your", "dummy", "sample", "xxxx", "test")

_PROVIDER = re.compile("|".join(f"(?:{p})" for p in PROVIDER_FORMS))
_PROVIDER_AT = re.compile(rf"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))(?:{_PROVIDER.pattern})(?![A-Za-z0-9])".encode())
_SECRET_KEY = re.compile("|".join(SECRET_KEYS), re.I)
_SECRET_AT = re.compile(_SECRET_KEY.pattern.encode(), re.I)
_EXAMPLE = re.compile("|".join(EXAMPLE_WORDS), re.I)
# the whole value of a key that holds a secret: up to its closing quote, or up to a blank, a bracket or the next key
_QUOTE = rb"""\\?(?:["'`]|\xE2\x80[\x98-\x9F]|\xC2[\xAB\xBB])?"""
_SEPARATOR = rb"[ \t]*(?::=|=>|=|:(?!//))[ \t]*"
_KEYED = re.compile(rb"""[\w.\-]*""" + _QUOTE + _SEPARATOR + rb"""(?:"((?:\\.|[^"\\\r\n]){6,})"|'((?:\\.|[^'\\\r\n]){6,})'|"""
                    rb"""((?:(?![&,;?]["']?[\w.\-]+["']?[=:])(?:[!#-&(-;=?-\[\]-_a-|~]|[\xC3-\xD4][\x80-\xBF])){6,}))""")
_KEY_BEFORE = re.compile(rb"([A-Za-z][\w.\-]*)" + _QUOTE + _SEPARATOR + _QUOTE + rb"$")
# parts of a token lie between these: quotes and non-ASCII characters, and for the narrow parts separators too
_WIDE_CUT = np.zeros(256, bool)
_WIDE_CUT[[ord(c) for c in "\"'`"]] = True
_WIDE_CUT[0x80:] = True
_NARROW_CUT = _WIDE_CUT.copy()
_NARROW_CUT[[ord(c) for c in ",;{}[]()<>&?|\\"]] = True
_ASSIGN = re.compile(r"""^["'({\[]*([A-Za-z][\w.\-]*)["']?(?::=|=>|=|:(?!//))["']?(.*)$""", re.S)
_MAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
_NUMBER = re.compile(r"[+(]?[\d\s().,:/+\-]+%?")

FEATURES = ("length", "digits", "upper", "lower", "other", "hexadecimal", "entropy", "class_changes", "transition",
            "coverage", "longest_word", "has_key", "key_secret", "in_url", "in_mail", "in_path", "dots", "quoted",
            "before_secret", "before_assign", "before_known", "after_known", "before_hash", "after_hash")
FINDING = ("start long, length long, value string, key string, features array<double>, rule int")


@dataclass
class Dictionary:
    """``known``: sorted hashes of the known words; ``transitions``: log-probability of each pair of symbols."""

    known: np.ndarray
    transitions: np.ndarray


def _symbols(data: np.ndarray) -> np.ndarray:
    """Letters by value, digits as 27, blanks as 0, all other bytes hashed to 28 to 63."""
    return _SYMBOL[bytesx.lower(data)]


_SYMBOL = (28 + np.arange(256) % 36).astype(np.int64)
_SYMBOL[ord("a"):ord("z") + 1] = np.arange(1, 27)
_SYMBOL[ord("0"):ord("9") + 1] = 27
_SYMBOL[bytesx.SPACE] = 0


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each lower-cased run of letters."""
    low = bytesx.lower(data)
    starts, ends = bytesx.runs(bytesx.LETTER[data], offsets)
    return bytesx.span_hashes(low, starts, ends)


def dictionary(df: DataFrame, text_col: str = "text", min_count: int = 20, min_share: float = 5e-6) -> Dictionary:
    """Words seen at least ``min_count`` times that make up ``min_share`` of all, and character transitions."""
    def run(batches):
        pairs, total = np.zeros(SYMBOLS * SYMBOLS, np.int64), 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h = np.concatenate([p[0] for p in parts])
            u, inv = np.unique(h, return_inverse=True)
            return u, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)

        def rows(kind, key, n):
            for k in range(0, len(key), 1 << 16):
                own = key[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own),
                                                  pa.array(n[k:k + (1 << 16)])], ["kind", "word", "n"])

        for b in batches:
            data, off = bytesx.column_bytes(b.column(0))
            for lo, hi in bytesx.slices(off, SLICE_BYTES):
                d, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                h = _letters(d, o)
                total += len(h)
                parts.append(np.unique(h.view(np.int64), return_counts=True))
                if len(parts) > 8:
                    parts = [merged()]
                if len(parts) == 1 and len(parts[0][0]) > 1 << 20:  # so that a task holds little
                    yield from rows(0, *parts.pop())
                s = _symbols(d)
                pairs += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS)
        if parts:
            yield from rows(0, *merged())
        at = np.flatnonzero(pairs)
        yield from rows(1, at.astype(np.int64), pairs[at])
        yield from rows(2, np.zeros(1, np.int64), np.array([total], np.int64))
        parts.clear()
        release()
    counted = df.select(F.col(text_col).alias("text")).mapInArrow(run, "kind int, word long, n long")
    counted = materialize(counted.groupBy("kind", "word").agg(F.sum("n").alias("n")).where(
        (F.col("kind") > 0) | (F.col("n") >= min_count)), "secret-words")
    fixed = counted.where("kind > 0").toArrow()
    kind, at, n = (fixed.column(i).to_numpy() for i in range(3))
    least = max(min_count, min_share * float(n[kind == 2].sum()))
    known = counted.where((F.col("kind") == 0) & (F.col("n") >= F.lit(least))).select("word").toArrow()
    pairs = np.zeros(SYMBOLS * SYMBOLS)
    pairs[at[kind == 1]] = n[kind == 1]
    pairs = pairs.reshape(SYMBOLS, SYMBOLS) + 0.5
    return Dictionary(np.sort(known.column(0).to_numpy().view(np.uint64)), np.log(pairs / pairs.sum(1, keepdims=True)))


def _is_known(d: Dictionary, hashes: np.ndarray) -> np.ndarray:
    """Whether the word of each hash is in the dictionary."""
    if not len(d.known):
        return np.zeros(len(hashes), bool)
    return d.known[np.minimum(np.searchsorted(d.known, hashes), len(d.known) - 1)] == hashes


def _known_words(d: Dictionary, text: bytes) -> list[bool]:
    """Whether each run of letters of ``text`` is a dictionary word."""
    data = np.frombuffer(text, np.uint8)
    return _is_known(d, _letters(data, np.array([0, len(data)]))).tolist()


# what bytesx.span_hashes multiplies each byte by, and adds for the length
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(11, bytesx._R)]))
_LENGTHS = np.arange(13, dtype=np.uint64) * bytesx._M2


def _coverage(d: Dictionary, value: str) -> tuple[float, int]:
    """Share of the characters that dictionary words of three letters and more cover, and the longest such word."""
    raw = bytesx.lower(np.frombuffer(value.encode(), np.uint8))
    n = len(raw)
    if n < 3:
        return 0.0, 0
    letter = bytesx.LETTER[raw] & (raw < 0x80)
    v = raw.astype(np.uint64) + np.uint64(1)
    total, alpha = np.zeros(n, np.uint64), np.ones(n, bool)
    edges, longest = np.zeros(n + 1, np.int64), 0
    for k in range(1, min(n, 12) + 1):  # total: the sum that bytesx.span_hashes makes of the k bytes from each place
        m = n - k + 1
        total, alpha = total[:m] + v[k - 1:] * _POWERS[k - 1], alpha[:m] & letter[k - 1:]
        if k >= 3:
            at = np.flatnonzero(alpha)
            at = at[_is_known(d, bytesx.mix(total[at] + _LENGTHS[k]))]
            if len(at):
                longest = k
                edges[at] += 1
                edges[at + k] -= 1
    return float((np.cumsum(edges[:-1]) > 0).mean()), longest


def _assigned(token: str, key_before: str, whole: bool) -> re.Match | None:
    """Key and value of a token that is an assignment; padding at the end of a value is none."""
    m = None if whole or key_before else _ASSIGN.match(token)
    return m if m and m[2].strip("=") else None


def describe(d: Dictionary, token: str, before: list[str], after: list[str], key_before: str = "",
             whole: bool = False, in_quotes: bool = False) -> tuple[str, str, list[float], int]:
    """(value, key, features, rule) of a token between its neighbouring words; the rule is 1, 0 or -1 (not sure).

    A part of a token has the key that stands before it in ``key_before``; with ``whole``, all of it is the value.
    """
    m = _assigned(token, key_before, whole)
    near = " ".join(before[-3:])
    key, value = (m[1], m[2]) if m else ("", token)
    if not m and before and before[-1] in ("=", ":", ":=", "=>") and len(before) > 1:
        key = before[-2].strip("\"'")
    key = key or key_before
    quoted = in_quotes or token[:1] in "\"'" or value[:1] in "\"'" or token[-1:] in "\"'"
    if not whole:
        value = re.split("[\"'`]", value.lstrip("\"'`.,;:()[]{}<>"), maxsplit=1)[0].rstrip(".,;:!?#()[]{}<>")
    n = max(len(value), 1)
    count = {c: value.count(c) for c in set(value)}
    digits, upper, lower = (sum(f(c) for c in value) for f in (str.isdigit, str.isupper, str.islower))
    kinds = [(c.isdigit(), c.isupper(), c.islower()) for c in value]
    sym = _symbols(np.frombuffer(value.encode(), np.uint8))
    cover, longest = _coverage(d, value)
    known = [any(_known_words(d, w.encode())) if w else False for w in (before[-1:] or [""])[0:1] + after[:1]]
    in_mail, in_url = bool(_MAIL.search(token)), "://" in token or token.startswith("www.")
    features = [
        math.log1p(len(value)), digits / n, upper / n, lower / n, (n - digits - upper - lower) / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        -sum(x / n * math.log2(x / n) for x in count.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(d.transitions[sym[:-1], sym[1:]].mean()) if len(sym) > 1 else 0.0, cover, float(longest),
        float(bool(key)), float(bool(_SECRET_KEY.search(key))), float(in_url), float(in_mail),
        float("/" in token or "\\" in token), value.count(".") / n, float(quoted),
        float(bool(_SECRET_KEY.search(near))), float(bool(before) and before[-1][-1:] in "=:"),
        float(known[0]), float(known[-1]),
        float(zlib.crc32((before or [""])[-1].lower().encode()) % 16), float(zlib.crc32((after or [""])[0].lower().encode()) % 16)]
    example = bool(_EXAMPLE.search(value))
    rule = -1
    if _PROVIDER.fullmatch(value) and not example:
        rule = 1
    elif in_mail or in_url or _NUMBER.fullmatch(value) or example or len(value) < 6:
        rule = 0
    elif _SECRET_KEY.search(key) and len(value) >= 8 and features[6] >= 2.5:
        # "token: something" may be prose
        rule = 1 if cover <= 0.8 or quoted or digits else -1
    elif cover > 0.8:
        rule = 0
    return value, key, features, rule


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all tokens, and which of them are candidates."""
    starts, ends = bytesx.runs(~bytesx.SPACE[data], offsets)

    def inside(mask):
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[ends] - c[starts]
    size = ends - starts
    ascii_only = inside(data >= 0x80) == 0
    assign = inside((data == ord("=")) | (data == ord(":")))
    chosen = ascii_only & (size >= 8) & (size <= LONGEST) & (
        (inside(bytesx.DIGIT[data]) >= 2) | (assign > 0) & (inside(bytesx.LETTER[data]) >= 6))
    return starts, ends, chosen


def _spans(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray,
           chosen: np.ndarray) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of all candidates, whose tokens are ``starts`` to ``ends``; ``whole``: all of it is the value."""
    raw = data.tobytes()
    first = offsets[bytesx.rows_of(starts, offsets)]
    third = starts[np.maximum(np.arange(len(starts)) - 3, 0)]
    secret = np.array([m.start() for m in _SECRET_AT.finditer(raw)], np.int64)
    out = dict.fromkeys(zip(starts[chosen].tolist(), ends[chosen].tolist(), [False] * int(chosen.sum()), strict=True))
    digits, letters, assigns = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (
        bytesx.DIGIT[data], bytesx.LETTER[data], (data == ord("=")) | (data == ord(":"))))
    for cut in (_WIDE_CUT, _NARROW_CUT):
        lo, hi = bytesx.runs(~(cut | bytesx.SPACE)[data], offsets)
        of = np.searchsorted(starts, lo, "right") - 1
        back = np.maximum(np.maximum(third[of], first[of]), lo - 256)
        near = np.searchsorted(secret, hi) > np.searchsorted(secret, back)
        size = hi - lo
        take = (size >= 8) & ((digits[hi] - digits[lo] >= 2)
                              | (assigns[hi] > assigns[lo]) & (letters[hi] - letters[lo] >= 6)) | near & (size >= 6)
        out.update(dict.fromkeys(zip(lo[take].tolist(), hi[take].tolist(), [False] * int(take.sum()), strict=True)))
    edges = offsets.tolist()
    for r in np.flatnonzero(np.diff(offsets)).tolist():
        text = raw[edges[r]:edges[r + 1]]
        for m in _SECRET_AT.finditer(text):
            v = _KEYED.match(text, m.end())
            if v:
                a, z = v.span(v.lastindex)
                if v.lastindex == 3:
                    z = a + len(text[a:z].rstrip(b".,;:!?#()[]{}<>"))
                out[edges[r] + a, edges[r] + z, True] = None
        for m in _PROVIDER_AT.finditer(text):
            out[edges[r] + m.start(), edges[r] + m.start() + len(m[0].rstrip(b".")), True] = None
    return sorted(out)


def candidates(df: DataFrame, d: Dictionary, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``df`` and ``FINDING`` for every candidate in every text."""
    shared = df.sparkSession.sparkContext.broadcast(d)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def one(b):
        own = shared.value
        data, off = bytesx.column_bytes(b.column(len(keep)))
        for lo, hi in bytesx.slices(off, SLICE_BYTES):
            part, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            starts, ends, chosen = _tokens(part, o)
            row = bytesx.rows_of(starts, o)
            points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int64)])
            out, seen = [], set()

            def text(a, z):
                return bytes(part[a:z]).decode("utf-8", "ignore")

            def word(i, r):
                return text(starts[i], min(ends[i], starts[i] + 64)) if 0 <= i < len(starts) and row[i] == r else None
            for a, z, whole in _spans(part, o, starts, ends, chosen):
                i = int(np.searchsorted(starts, a, "right")) - 1
                last = int(np.searchsorted(starts, z - 1, "right")) - 1
                r = row[i]
                token = text(a, z)
                before = [w for w in (word(i - 3, r), word(i - 2, r), word(i - 1, r)) if w]
                after = [w for w in (word(last + 1, r), word(last + 2, r)) if w]
                inner, rest = text(max(starts[i], a - 64), a), text(z, min(ends[last], z + 64))
                before += [inner] if any(c.isalnum() or c in "=:" for c in inner) else []
                after = ([rest] if any(c.isalnum() for c in rest) else []) + after
                named = _KEY_BEFORE.search(bytes(part[max(o[r], a - 96):a]))
                named = named[1].decode("ascii") if named else ""
                value, key, features, rule = describe(own, token, before, after, named, whole,
                                                      inner[-1:] in ("\"", "'", "`"))
                m = _assigned(token, named, whole)
                at = max(token.find(value, m.start(2) if m else 0), 0)
                start = int(points[a] - points[o[r]]) + at
                if (r, start, len(value)) in seen:
                    continue
                seen.add((r, start, len(value)))
                out.append((lo + r, start, len(value), value, key, features, rule))
            if out:
                r, start, length, value, key, features, rule = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(pa.array(r)) for c in range(len(keep))), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(value), pa.array(key), pa.array(features),
                     pa.array(rule, pa.int32())], [*keep, "start", "length", "value", "key", "features", "rule"])

    return map_batches(df.select(*keep, F.col(text_col).alias("_llm_text")), one, f"{fields}, {FINDING}")


def fit(findings: DataFrame, max_findings: int = 50_000, trees: int = 40, depth: int = 6,
        seed: int = 7) -> RandomForestClassificationModel | float:
    """A forest on labelled findings (features, label); the only label's value if there is but one."""
    known = findings.where(F.col("label").isin(0, 1)).select("label", "features")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0))
    # the same share by hash on every run; a finding is taken or not by its own features
    share = {k: min(1.0, max_findings / 2 / n) for k, n in counts.items()}
    drawn = F.pmod(F.xxhash64("features"), F.lit(1_000_000)) / F.lit(1e6)
    sample = known.where(drawn < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    sample = materialize(sample.select(F.col("label").cast("double"), "features"), "secret-sample")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="v").fit(
        sample.select("label", array_to_vector("features").alias("v")))


def score(findings: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """Adds ``score``, the forest's probability that a finding is a secret."""
    if isinstance(model, float):
        return findings.withColumn("score", F.lit(model))
    v = model.transform(findings.withColumn("v", array_to_vector("features")))
    return v.withColumn("score", vector_to_array("probability")[1]).drop("v", "rawPrediction", "probability", "prediction")


def scan(df: DataFrame, keep: list[str], text_col: str = "text", labelled: DataFrame | None = None,
         threshold: float = 0.5, name: str = "secret-findings") -> DataFrame:
    """Every candidate of every text with ``score`` and ``is_secret``; ``keep`` columns lead."""
    d = dictionary(df, text_col)
    found = materialize(candidates(df, d, keep, text_col), name)
    model = fit(labelled if labelled is not None else found.withColumn("label", F.col("rule")))
    return score(found, model).withColumn("is_secret", F.col("score") >= threshold)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """``df`` with every confirmed secret in ``text_col`` replaced by ``mark``; other columns and rows stay.

    Secrets are found per distinct text, so copies are scanned once; the parts between secrets are joined natively.
    """
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    texts = df.select(key.alias("_llm_key"), F.col(text_col).alias("_llm_text"))
    found = scan(texts, ["_llm_key"], "_llm_text", threshold=threshold).where("is_secret")
    spans = materialize(found.select("_llm_key", F.struct("start", "length").alias("s")).distinct().groupBy("_llm_key").agg(
        F.array_sort(F.collect_list("s")).alias("_llm_spans")), "secret-spans")
    joined = join_checked(df.withColumn("_llm_key", key), spans, "_llm_key", "left", row_bytes=512)
    whole = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def cut(acc, s):
        end = s["start"] + s["length"]
        apart = F.struct(F.concat(acc["done"], F.substring(text_col, (acc["at"] + 1).cast("int"),
                                                           (s["start"] - acc["at"]).cast("int")),
                                  F.lit(mark)).alias("done"), end.alias("at"))
        # a span that begins inside the one before has its mark already
        joined = F.struct(acc["done"].alias("done"), F.greatest(acc["at"], end).alias("at"))
        return F.when((s["start"] < acc["at"]) & (acc["at"] > 0), joined).otherwise(apart)

    def rest(acc):
        return F.concat(acc["done"], F.substring(text_col, (acc["at"] + 1).cast("int"), F.length(text_col)))
    clean = F.when(F.col("_llm_spans").isNull(), F.col(text_col)).otherwise(
        F.aggregate("_llm_spans", whole, cut, rest))
    return joined.withColumn(text_col, clean).select(*df.columns)
