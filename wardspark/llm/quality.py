"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Random indexing: every word (by hash, in ``buckets`` of them) has a sparse random index vector; a word's vector is the
sum of the index vectors of its neighbours, two on either side, over all texts, brought to length 1. A document is
described by the mean and the mean square of its words' vectors, the mean of their index vectors (which repetition
makes long), the likeness of neighbouring words, and its length. A network of one hidden layer learns labels from that; its
temperature is fitted on rows that the network wasn't trained on, so that scores are probabilities.

Words are runs of letters and digits, lower-cased, and every other mark by itself, so layout shows.

Size bounds: the word vectors are ``buckets * dims`` numbers (4 MB at the defaults), whatever the corpus; that and the
network are broadcast. Word vectors are gathered from all texts. The network is fitted on exactly the ``max_fit``
distinct labelled texts of least hash (all, if fewer), one with n copies with the weight 1 + ln n; the bound only limits
the training set.

Defined cases: null and empty texts have zero features and get the network's answer for those. With labels of one
kind only every score is that label (0 without any). Rows with a null label aren't learned from; equal texts score
alike. Reruns agree: all random numbers have a seed, and sums of integers don't depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.llm import bytesx
from wardspark.llm.common import SLICE_BYTES, map_batches, release
from wardspark.llm.toxicity import distinct_texts, drawn
from wardspark.session import materialize

BUCKETS = 1 << 14
DIMS = 64
NONZERO = 4
_WORD = bytesx.LETTER | bytesx.DIGIT


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def index_vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    place = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    return place, rng.choice([-1, 1], (BUCKETS, NONZERO))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word or mark, and the row offsets into them."""
    low = bytesx.lower(data)
    word = _WORD[data]
    starts, ends = bytesx.runs(word, offsets)
    mark = np.flatnonzero(~word & ~bytesx.SPACE[data])
    start = np.concatenate([starts, mark])
    end = np.concatenate([ends, mark + 1])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    bucket = (bytesx.span_hashes(low, start, end) >> np.uint64(64 - 14)).astype(np.int64)
    return bucket, np.searchsorted(start, offsets)


def word_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all buckets, from the neighbours of all words in all texts."""
    place, sign = index_vectors()

    def run(batches):
        total = np.zeros(BUCKETS * DIMS, np.int64)
        seen = False
        for b in batches:
            data, off = bytesx.column_bytes(b.column(0))
            for lo, hi in bytesx.slices(off, 6 * SLICE_BYTES):
                w, at = words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                for distance in (1, 2):
                    same = np.flatnonzero(row[distance:] == row[:-distance])
                    a, c = w[same], w[same + distance]
                    for own, other in ((a, c), (c, a)):
                        for j in range(NONZERO):
                            total += np.bincount(own * DIMS + place[other, j], sign[other, j],
                                                 BUCKETS * DIMS).astype(np.int64)
                seen = True
        if seen:
            sums = total.reshape(BUCKETS, DIMS)
            at = np.flatnonzero(sums.any(1))
            for k in range(0, len(at), 4096):
                s = at[k:k + 4096]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * DIMS),
                                                 pa.array(sums[s].astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), lists], ["bucket", "v"])
        del total
        release()

    parts = df.select(F.col(text_col).alias("t")).mapInArrow(run, "bucket int, v array<int>")

    def add(t: pa.Table) -> pa.Table:
        m = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, DIMS).astype(np.int64).sum(0)
        return pa.table({"bucket": t["bucket"].slice(0, 1), "v": pa.array([m.tolist()], pa.list_(pa.int64()))})
    rows = parts.groupBy("bucket").applyInArrow(add, "bucket int, v array<bigint>").toArrow()
    out = np.zeros((BUCKETS, DIMS))
    if rows.num_rows:
        out[rows["bucket"].to_numpy()] = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(vectors: np.ndarray, place: np.ndarray, sign: np.ndarray, data: np.ndarray,
             offsets: np.ndarray) -> np.ndarray:
    """Pooled description of each row."""
    w, at = words(data, offsets)
    n, size = len(offsets) - 1, np.diff(at)
    out = np.zeros((n, 3 * DIMS + 4), np.float32)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    first, count = at[:-1][full], size[full]
    v = vectors[w]
    ones = np.ones(int(count.max()), np.float32)
    for r, lo, k in zip(full.tolist(), first.tolist(), count.tolist(), strict=True):
        x = v[lo:lo + k]
        out[r, :DIMS] = ones[:k] @ x
        out[r, DIMS:2 * DIMS] = np.einsum("ij,ij->j", x, x)
        out[r, 3 * DIMS] = np.einsum("ij,ij->", x[:-1], x[1:])
    out[full, :2 * DIMS] /= count[:, None]
    out[full, 3 * DIMS] /= count
    row = np.repeat(np.arange(n), size)
    own = np.zeros(n * DIMS)
    for j in range(NONZERO):
        own += np.bincount(row * DIMS + place[w, j], sign[w, j], n * DIMS)
    own = own.reshape(n, DIMS) / np.maximum(size, 1)[:, None]
    out[:, 2 * DIMS:3 * DIMS] = own
    same = np.zeros(len(w), np.float32)
    same[:-1] = (w[:-1] == w[1:]) & (row[:-1] == row[1:])
    out[full, 3 * DIMS + 1] = np.add.reduceat(same, first) / count
    out[:, 3 * DIMS + 2] = np.linalg.norm(own, axis=1)
    out[:, 3 * DIMS + 3] = np.log1p(size)
    return out


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5, ridge: float = 1e-4,
        weight: np.ndarray | None = None) -> Network:
    """Network on weighted features and labels 0 and 1, with Adam; every fifth row only fits the temperature."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    d = x.shape[1]
    weight = np.ones(len(x)) if weight is None else weight / max(weight.mean(), 1e-9) if len(x) else weight
    if len(np.unique(y)) < 2:
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0,
                       constant=float(y[0]) if len(y) else 0.0)
    net = Network(x.mean(0), x.std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden),
                  rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    aside = np.arange(len(x)) % 5 == 4
    z = net.standard(x)
    zt, yt, wt = z[~aside], y[~aside], weight[~aside]
    if len(np.unique(yt)) < 2:
        zt, yt, wt = z, y, weight
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    t = 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        order = rng.permutation(len(zt))
        for lo in range(0, len(order), 128):
            i = order[lo:lo + 128]
            h = np.tanh(zt[i] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - yt[i]) * wt[i] / len(i)
            back = np.outer(e, p[2]) * (1 - h * h)
            t += 1
            for k, g in enumerate((zt[i].T @ back + ridge * p[0], back.sum(0), h.T @ e + ridge * p[2],
                                   np.array([e.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if aside.any():
        logit = net.logits(x[aside])
        steps = np.exp(np.linspace(np.log(0.3), np.log(10), 60))
        loss = [(weight[aside] * np.logaddexp(0, -np.where(y[aside] > 0, 1, -1) * logit / q)).mean() for q in steps]
        net.temperature = float(steps[int(np.argmin(loss))])
    return net


def _apply(df: DataFrame, keep: list[str], shared, out: str, kind: str, finish) -> DataFrame:
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def one(b):
        vectors, place, sign, net = shared.value
        data, off = bytesx.column_bytes(b.column(len(keep)))
        x = np.concatenate([features(vectors, place, sign, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                            for lo, hi in bytesx.slices(off, SLICE_BYTES)])
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(keep))), finish(net, x)], [*keep, out])
    return map_batches(df, one, f"{fields}{out} {kind}")


def learn(df: DataFrame, labelled: DataFrame, label_col: str = "quality", text_col: str = "text",
          max_fit: int = 20_000) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts of ``df``, and a network from ``labelled`` (text, label)."""
    vectors = word_vectors(df, text_col)
    sample = drawn(materialize(distinct_texts(labelled, label_col, text_col), "quality-rows"), max_fit)
    sample = sample.select("label", "h", "n", "text")
    shared = df.sparkSession.sparkContext.broadcast((vectors, *index_vectors(), None))

    def pack(_, x):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]),
                                        pa.array(x.ravel()))
    found = materialize(_apply(sample, ["label", "h", "n"], shared, "x", "array<float>", pack), "quality-sample")
    t = found.orderBy("h", "label").toArrow()
    shared.unpersist()
    y = t["label"].to_numpy()
    x = t["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 3 * DIMS + 4))
    return vectors, fit(x, y, weight=1 + np.log(t["n"].to_numpy()))


def score(df: DataFrame, model: tuple[np.ndarray, Network], keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score``, the calibrated probability of label 1."""
    vectors, net = model
    shared = df.sparkSession.sparkContext.broadcast((vectors, *index_vectors(), net))
    rows = df.select(*keep, F.col(text_col).alias("_llm_text"))
    return _apply(rows, keep, shared, "score", "double", lambda n, x: pa.array(n.probability(x.astype(np.float64))))
