"""Toxicity: class-conditional Kneser-Ney models of words, smoothed through shared backoff counts.

A text is a sequence of tokens in lower case: runs of letters and digits of any script, and in scripts that are written
without blanks (and for pictures) each character joined with the one after it. Tokens and pairs of tokens are 64-bit
hashes, counted in a Spark aggregation whose result grows with the corpus; equal texts count once, and a pair once a text.

For each class, toxic and ordinary:

* a word's probability comes from how many different words precede it in that class (its continuation count), less
  ``WORD_DISCOUNT``; what the discounts hold back goes to the continuation counts of both classes together;
* a pair's probability comes from the texts of that class that hold it, less ``PAIR_DISCOUNT``, and what is held back
  in its context, in both classes together, goes to the class's probability of the second word. A class that has
  nothing of its own in a context takes the context's shared counts.

So a word or pair too rare in both classes has equal probabilities in both and says nothing. The comparison
log P(toxic) - log P(ordinary) of a word, and what a pair adds to that of its second word, are kept where they are at
least ``LEAST``; the others are taken as zero, which moves no comparison by more.

A text's score compares the two log-likelihoods, each normalised by length: over the whole text, and over every run of
a few tokens, of which the highest count, as an insult is short and a text may be long. A logistic regression on these
comparisons, fitted on held-out folds of the training texts, gives the probability.

Size bounds: a model whose counted entries take at most ``BROADCAST_BYTES`` is broadcast; a larger one stays a table,
which the distinct tokens and pairs of chunks of texts are joined to. Nothing else of the model reaches the driver but
sums. The regression is fitted on exactly the ``max_fit`` distinct texts of least hash (all, if fewer); a text with n
copies has the weight 1 + ln n.

Defined cases: null and empty texts have no comparison and get the score of the regression's zero features. A text
shorter than a run is one run. Without toxic or without ordinary rows to learn from, every score is that class's share
(0 or 1; 0 without any rows). Rows with a null label are not learned from; equal texts score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import bytesx
from wardspark.llm.common import BROADCAST_BYTES, SLICE_BYTES, map_batches, release
from wardspark.session import materialize

WORD_DISCOUNT = 1.5
PAIR_DISCOUNT = 2.5
LEAST = 0.25
WORD_RUNS, PAIR_RUNS = (1, 4, 16), (1, 8)
TOP = 3
N_FEATURES = 2 + TOP * (len(WORD_RUNS) + len(PAIR_RUNS))
#: Learning folds: model 0 is of all texts outside fold 0, model 1 of those outside fold 1, model 2 of all.
MODELS = (0, 1, 2)
ENTRY_BYTES = 12
#: Bytes of text that one group holds where the model is joined.
CHUNK_BYTES = 8 << 20
#: Distinct pairs that a counting task holds before it passes them on.
HELD_PAIRS = 1_000_000
#: In place of a pair's first word: the row holds how many pairs begin with the second one.
CONTEXT = -2

_U = np.uint64
# Fixed ranges of code points: no letters, and characters that are tokens without blanks between them.
_NO_LETTERS = ((0x80, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x2BFF), (0x3000, 0x303F), (0xFE30, 0xFE6F),
               (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFFE0, 0xFFFF))
_UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FFF), (0x3040, 0x9FFF), (0xF900, 0xFAFF),
             (0x1F000, 0x1FAFF), (0x20000, 0x3FFFF))


def _kinds(point: np.ndarray) -> np.ndarray:
    """Of each code point: 0 no letter, 1 letter or digit of a word, 2 a token of its own."""
    kind = ((point >= 0x80) | (point >= 97) & (point <= 122) | (point >= 65) & (point <= 90)
            | (point >= 48) & (point <= 57)).astype(np.uint8)
    for ranges, k in ((_NO_LETTERS, 0), (_UNSPACED, 2)):
        for lo, hi in ranges:
            kind[(point >= lo) & (point <= hi)] = k
    return kind


_ASCII = _kinds(np.arange(0x80))


def lowered(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column in lower case; null counts as empty."""
    return bytesx.column_bytes(pc.utf8_lower(column.cast(pa.large_string())))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of lower-case texts, and row offsets into them."""
    n = len(data)
    kind = _ASCII[np.minimum(data, 0x7F)]
    wide = np.flatnonzero(data >= 0xC0)
    kind[data >= 0x80] = 0
    if len(wide):
        b = [data[np.minimum(wide + j, n - 1)].astype(np.int64) & 0x3F for j in range(4)]
        lead = data[wide]
        two, three = lead < 0xE0, lead < 0xF0
        point = np.select([two, three], [(b[0] & 31) << 6 | b[1], (b[0] & 15) << 12 | b[1] << 6 | b[2]],
                          (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3])
        size = np.select([two, three], [2, 3], 4)
        k = _kinds(point)
        for j in range(4):
            kind[wide[size > j] + j] = k[size > j]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= (kind == 2) & ((data & 0xC0) != 0x80)
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)[:len(starts)]
    used = kind[starts] > 0
    starts, ends = starts[used], ends[used]
    h = bytesx.span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    if len(h) > 1:
        joint = (kind[starts[:-1]] == 2) & (kind[starts[1:]] == 2) & (ends[:-1] == starts[1:])
        edge = at[1:-1]
        joint[edge[(edge > 0) & (edge < len(h))] - 1] = False
        j = np.flatnonzero(joint)
        h[j] = pair_keys(h[j], h[j + 1])
    return h, at


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return bytesx.mix(a * bytesx._R + b)


def _before(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before each one, 0 at the beginning of a row."""
    a = np.zeros_like(h)
    a[1:] = h[:-1]
    first = at[:-1][np.diff(at) > 0]
    a[first] = 0
    return a


def _grouped(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` with the sums of ``n``."""
    if not len(n):
        return columns, n
    order = np.lexsort(columns)
    sorted_ = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_])
    first = np.flatnonzero(new)
    return [c[first] for c in sorted_], np.add.reduceat(n[order], first)


def _counted(rows: DataFrame) -> DataFrame:
    """(k, a, b, n) over texts (text, label, fold): how many hold the pair a, b; k is 2 fold + label.

    With ``CONTEXT`` for a, n is the number of pairs that begin with b. A task adds up what it has seen.
    """
    def out(columns, n):
        for lo in range(0, len(n), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0][s].astype(np.int32)), *(
                pa.array(c[s].view(np.int64)) for c in columns[1:]), pa.array(n[s])], ["k", "a", "b", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            data, off = lowered(batch.column(0))
            k_row = batch.column(1).to_numpy() + 2 * batch.column(2).to_numpy()
            for lo, hi in bytesx.slices(off, SLICE_BYTES):
                h, at = tokens(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                row = np.repeat(np.arange(lo, hi), np.diff(at))
                (row, a, b), _ = _grouped([row, _before(h, at), h], np.ones(len(h), np.int64))
                k = k_row[row].astype(np.uint64)
                one = np.ones(len(a), np.int64)
                inside = a != 0
                parts = [_grouped([k, a, b], one),
                         _grouped([k[inside], np.full(int(inside.sum()), CONTEXT, np.int64).view(_U), a[inside]],
                                  one[inside])]
                held += parts
                size += sum(len(n) for _, n in parts)
                if size > HELD_PAIRS:
                    held = [_merged(held)]
                    size = len(held[0][1])
                    if size > HELD_PAIRS // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*_merged(held))
        held.clear()
        release()

    def _merged(parts):
        return _grouped([np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)],
                        np.concatenate([p[1] for p in parts]))
    return rows.select("text", "label", "fold").mapInArrow(run, "k int, a long, b long, n long")


def counts(rows: DataFrame) -> DataFrame:
    """One row per word b (a null), context b (a ``CONTEXT``) and pair a, b that a class holds often enough.

    ``t0 o0 t1 o1 t2 o2``: for a word how many words precede it, toxic and ordinary, in each of ``MODELS``, and ``c0 c1
    c2`` in both classes together; for a context and a pair the counts. One shuffle, by the second word: what precedes
    a frequent word has been added up by the tasks before.
    """
    k, n = F.col("k"), F.col("n")
    pairs = _counted(rows).repartition("b").groupBy("b", "a").agg(
        *(F.sum(F.when(k == 2 * (1 - m) + label, n).otherwise(0)).alias(f"{name}{m}")
          for m in (0, 1) for name, label in (("t", 1), ("o", 0))))
    pairs = pairs.withColumns({"t2": F.col("t0") + F.col("t1"), "o2": F.col("o0") + F.col("o1")})
    context = F.col("a") == CONTEXT
    often = (F.col("t2") > PAIR_DISCOUNT) | (F.col("o2") > PAIR_DISCOUNT)
    both = F.expr("array(null, a)")
    to = F.when(context, F.array("a")).when(often, both).otherwise(F.expr("array(cast(null AS long))"))
    rows = pairs.select("b", F.explode(to).alias("g"), *(f"{x}{m}" for m in MODELS for x in "to"))
    word = F.col("g").isNull()

    def total(m, x):
        return F.sum(F.when(word, (F.col(f"{x}{m}") > 0).cast("long")).otherwise(F.col(f"{x}{m}"))).alias(f"{x}{m}")
    return rows.groupBy("b", "g").agg(
        *(total(m, x) for m in MODELS for x in "to"),
        *(F.sum(F.when(F.col(f"t{m}") + F.col(f"o{m}") > 0, 1).otherwise(0)).alias(f"c{m}") for m in MODELS)
    ).withColumnRenamed("g", "a")


def _discounted(c: str, discount: float):
    return F.greatest(F.col(c) - F.lit(discount), F.lit(0.0))


def compare(grams: DataFrame) -> DataFrame:
    """(key, kind, v0, v1, v2) of ``counts``: the comparisons of words (kind 0) and what pairs add (kind 1)."""
    words = grams.where("a IS NULL")
    sums = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for m in MODELS for c in (f"t{m}", f"o{m}", f"c{m}")),
                     *(F.coalesce(F.sum(_discounted(f"{x}{m}", WORD_DISCOUNT)), F.lit(0.0)).alias(f"w_{x}{m}")
                       for m in MODELS for x in "to")).first().asDict()

    def probability(m, x):
        seen = sums[f"n_t{m}"] + sums[f"n_o{m}"]
        kept = (sums[f"w_t{m}"] + sums[f"w_o{m}"]) / seen if seen else 0.0
        shared = F.col(f"c{m}") / F.lit(float(max(sums[f"n_c{m}"], 1)))
        mine = sums[f"w_{x}{m}"]
        if not mine:
            return shared
        return _discounted(f"{x}{m}", WORD_DISCOUNT) * F.lit(kept / mine) + shared * F.lit(1 - kept)

    p = words.select("b", *(probability(m, x).alias(f"p_{x}{m}") for m in MODELS for x in "to"))

    def ratio(m):
        return F.when(F.col(f"p_t{m}") > 0, F.ln(F.col(f"p_t{m}")) - F.ln(F.col(f"p_o{m}"))).otherwise(0.0)
    p = p.select("*", *(ratio(m).alias(f"v{m}") for m in MODELS))

    pairs = grams.where(f"a IS NOT NULL AND a <> {CONTEXT}").select(
        "a", "b", *(_discounted(f"{x}{m}", PAIR_DISCOUNT).alias(f"d_{x}{m}") for m in MODELS for x in "to"))
    own = pairs.groupBy("a").agg(*(F.sum(f"d_{x}{m}").alias(f"s_{x}{m}") for m in MODELS for x in "to"))
    begun = grams.where(f"a = {CONTEXT}").select(F.col("b").alias("a"), *(
        (F.col(f"t{m}") + F.col(f"o{m}")).alias(f"begun{m}") for m in MODELS))
    x = pairs.join(own.join(begun, "a"), "a").join(p, "b")

    def added(m):
        held = F.col(f"s_t{m}") + F.col(f"s_o{m}")
        kept = F.try_divide(held, F.col(f"begun{m}"))
        shared = F.try_divide(F.col(f"d_t{m}") + F.col(f"d_o{m}"), held)

        def q(c):
            mine = F.when(F.col(f"s_{c}{m}") > 0, F.try_divide(F.col(f"d_{c}{m}"), F.col(f"s_{c}{m}"))).otherwise(shared)
            return kept * mine + (1 - kept) * F.col(f"p_{c}{m}")
        known = (held > 0) & (F.col(f"p_t{m}") > 0)
        return F.when(known, F.ln(q("t")) - F.ln(q("o")) - F.col(f"v{m}")).otherwise(0.0)
    pairs = x.select("a", "b", *(added(m).alias(f"v{m}") for m in MODELS))
    telling = " OR ".join(f"abs(v{m}) >= {LEAST}" for m in MODELS)

    def key(batch):
        a, b = (batch.column(i).to_numpy().view(_U) for i in range(2))
        return pa.RecordBatch.from_arrays(
            [pa.array(pair_keys(a, b).view(np.int64)), pa.array(np.ones(len(a), np.int32)),
             *(batch.column(2 + m) for m in MODELS)], ["key", "kind", *(f"v{m}" for m in MODELS)])
    pairs = map_batches(pairs.where(telling), key, "key long, kind int, v0 double, v1 double, v2 double")
    return p.where(telling).select(F.col("b").alias("key"), F.lit(0).alias("kind"), *(f"v{m}" for m in MODELS)).union(pairs)


@dataclass
class Table:
    """Entries (key, v) of one model: numpy arrays in order of the key, or a DataFrame if they are too many."""

    entries: tuple[np.ndarray, np.ndarray] | DataFrame


def _table(compared: DataFrame, m: int) -> Table:
    entries = compared.where(f"abs(v{m}) >= {LEAST}").select("key", F.col(f"v{m}").cast("float").alias("v"))
    if entries.count() * ENTRY_BYTES > BROADCAST_BYTES:
        return Table(entries)
    t = entries.toArrow()
    return Table(_in_order(t.column(0).to_numpy().view(_U), t.column(1).to_numpy()))


def _in_order(keys: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], v[order].astype(np.float32)


def _look_up(entries: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The comparison of each key, 0 for those that the model lacks."""
    known, v = entries
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, v[at], 0).astype(np.float64)


def _highest(value: np.ndarray, at: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """Per row the mean of ``value``, and the ``TOP`` highest means of runs of each length that don't overlap."""
    n = len(at) - 1
    size = np.diff(at)
    out = np.zeros((n, 1 + TOP * len(lengths)))
    sums = np.concatenate([[0], np.cumsum(value)])
    out[:, 0] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(size, 1)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    row = np.repeat(np.arange(n), size)
    for j, w in enumerate(lengths):
        # the run that begins at each token, cut off at the end of its row
        mean = (sums[np.minimum(np.arange(len(value)) + w, at[1:][row])] - sums[:-1]) / w
        for k in range(TOP):
            top = np.zeros(n)
            top[some] = np.maximum.reduceat(mean, at[some])
            out[:, 1 + j * TOP + k] = np.maximum(top, 0)
            hit = np.flatnonzero((mean >= np.repeat(top, size)) & (mean > 0))
            if k + 1 == TOP or not len(hit):
                break
            _, first = np.unique(row[hit], return_index=True)
            best = hit[first]
            for d in range(-w + 1, w):
                p = best + d
                ok = (p >= at[row[best]]) & (p < at[row[best] + 1])
                mean[p[ok]] = -99
    return out


def features(entries: tuple[np.ndarray, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per lower-case row the comparisons of whole text and highest runs, of words and then of what pairs add."""
    h, at = tokens(data, offsets)
    words = _look_up(entries, h)
    pairs = _look_up(entries, pair_keys(_before(h, at), h))
    return np.hstack([_highest(words, at, WORD_RUNS), _highest(pairs, at, PAIR_RUNS)])


def _all_features(entries, column) -> pa.Array:
    data, off = lowered(column)
    x = np.concatenate([np.zeros((0, N_FEATURES)), *(
        features(entries, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]) for lo, hi in bytesx.slices(off, SLICE_BYTES))])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights (constant first) by Newton iterations."""
    weight = np.ones(len(x)) if weight is None else weight
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """``weights``: of the features, the first for the constant."""

    table: Table
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None


def distinct_texts(df: DataFrame, label_col: str, text_col: str) -> DataFrame:
    """(text, label, n, fold, h): the distinct labelled texts with their number of copies; equal texts share a fold."""
    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                     F.col(label_col).cast("long").alias("label")).where("label in (0, 1)")
    return rows.groupBy("text", "label").agg(F.count(F.lit(1)).alias("n")).select(
        "*", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold"), F.xxhash64("text", F.lit(1)).alias("h"))


def drawn(rows: DataFrame, max_fit: int) -> DataFrame:
    """The ``max_fit`` rows of least ``h``; ties at the bound are cut by label."""
    if rows.count() <= max_fit:
        return rows
    last = rows.select("h", "label").orderBy("h", "label").limit(max_fit).agg(
        F.max(F.struct("h", "label")).alias("x")).first()["x"]
    return rows.where((F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("label") <= last["label"]))


def learn(df: DataFrame, label_col: str = "toxic", text_col: str = "text", max_fit: int = 20_000) -> Model:
    """Model from all rows of ``df`` whose label is 0 or 1."""
    rows = materialize(distinct_texts(df, label_col, text_col), "toxicity-rows")
    labels = {r["label"] for r in rows.select("label").distinct().collect()}
    empty = np.zeros(N_FEATURES)
    if len(labels) < 2:
        none = Table((np.zeros(0, _U), np.zeros(0, np.float32)))
        return Model(none, np.zeros(N_FEATURES + 1), empty, empty + 1, float(1 in labels))
    grams = materialize(counts(rows), "toxicity-counts")
    compared = materialize(compare(grams), "toxicity-model")
    sample = drawn(rows, max_fit)
    ys, ws, xs = [], [], []
    for m in (0, 1):
        found = score_features(sample.where(F.col("fold") == m), _table(compared, m), ["label", "n", "h"])
        t = found.toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
        ys.append(t.column("label").to_numpy().astype(np.float64))
        ws.append(1 + np.log(t.column("n").to_numpy()))
        xs.append(t.column("features").combine_chunks().flatten().to_numpy().reshape(len(t), N_FEATURES))
    x, y, weight = (np.concatenate(z) for z in (xs, ys, ws))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    return Model(_table(compared, 2), _logistic((x - mean) / scale, y, weight), mean, scale)


def score_features(df: DataFrame, table: Table, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``features`` of every row."""
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + "features array<double>"
    if isinstance(table.entries, DataFrame):
        return _joined(df, table.entries, keep, fields, text_col)
    shared = df.sparkSession.sparkContext.broadcast(table.entries)

    def one(b):
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(keep))),
                                           _all_features(shared.value, b.column(len(keep)))], [*keep, "features"])
    return map_batches(df.select(*keep, F.col(text_col).alias("_llm_text")), one, fields)


def _joined(df: DataFrame, entries: DataFrame, keep: list[str], fields: str, text_col: str) -> DataFrame:
    """The same by a join: rows are dealt into chunks, a chunk's distinct keys fetch their entries, and both meet."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunk = F.pmod(F.xxhash64(*keep, text), F.lit(int(size // CHUNK_BYTES + 1))).alias("_llm_chunk")
    rows = df.select(*keep, text.alias("_llm_text"), chunk)

    def wanted(batch):
        data, off = lowered(batch.column(0))
        c = batch.column(1).to_numpy()
        for lo, hi in bytesx.slices(off, SLICE_BYTES):
            h, at = tokens(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            part = np.repeat(c[lo:hi], np.diff(at))
            (part, key), _ = _grouped([np.tile(part, 2), np.concatenate([h, pair_keys(_before(h, at), h)])],
                                      np.ones(2 * len(h), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key.view(np.int64))], ["_llm_chunk", "key"])
    keys = map_batches(rows.select("_llm_text", "_llm_chunk"), wanted, "_llm_chunk long, key long").distinct()
    found = keys.join(entries, "key")

    def meet(texts: pa.Table, known: pa.Table) -> pa.Table:
        held = _in_order(known.column("key").to_numpy().view(_U), known.column("v").to_numpy())
        x = _all_features(held, texts.column("_llm_text").combine_chunks())
        return pa.Table.from_arrays([*(texts.column(i) for i in range(len(keep))), x], [*keep, "features"])
    return rows.groupBy("_llm_chunk").cogroup(found.groupBy("_llm_chunk")).applyInArrow(meet, fields)


def score(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``score`` and the ``features`` it comes from."""
    if model.constant is not None:
        return df.select(*keep, F.lit(model.constant).alias("score"))
    x = score_features(df, model.table, keep, text_col)
    w = model.weights[1:] / model.scale
    base = model.weights[0] - float((w * model.mean).sum())
    z = sum((F.col("features")[j] * float(v) for j, v in enumerate(w)), F.lit(float(base)))
    return x.select(*keep, (1 / (1 + F.exp(-z))).alias("score"), "features")
